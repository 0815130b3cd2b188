"""Queries composed of operators, bound to tables."""
