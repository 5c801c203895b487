"""Whole plans built from the operators, derived test tables and the query registry."""
