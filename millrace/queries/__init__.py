"""Registered queries: each operator run over the given tables, next to the equivalent SQL."""
