"""Scalar functions as Column expressions, and the exact number format of reports."""
