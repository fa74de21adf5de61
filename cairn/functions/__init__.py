"""Scalar functions as Columns or Arrow UDFs."""
