"""Composed jobs: ordered steps, rules, outputs and quality gates."""
