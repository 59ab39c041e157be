"""Scalar functions: column expressions and Arrow UDFs."""
