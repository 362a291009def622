"""Expressions, predicates and whole specifications, compiled once to Columns and DataFrames."""
