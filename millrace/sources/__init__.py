"""Readers, writers, the model store and scratch space on shared storage."""
