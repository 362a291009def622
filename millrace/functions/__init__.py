"""Scalar functions as Columns: text, numbers, dates, titles, infix expressions."""
