"""Operators: lazy functions DataFrame -> DataFrame without I/O and without actions."""
