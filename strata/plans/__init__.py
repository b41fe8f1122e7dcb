"""Whole runs composed of operators, the fixtures derived from the test tables, and the catalog of queries."""
