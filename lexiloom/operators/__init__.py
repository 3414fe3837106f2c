"""Operators: relational access, statistics, structure, controls and search."""
