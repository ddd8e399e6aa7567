"""Operators over slide tables, one module for each family."""
