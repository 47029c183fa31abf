"""Column-level building blocks: fixed values, type families, text and vectors."""
