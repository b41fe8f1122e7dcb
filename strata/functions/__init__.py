"""Column expressions: typing, rounding, enrichment. All are built-in functions, so they stay in generated code."""
