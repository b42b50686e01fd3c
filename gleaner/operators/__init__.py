"""Operators: metric catalogue, search and filters, changes, integrity checks."""
