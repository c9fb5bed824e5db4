"""Scalar functions: tokenising, normalising, formatting."""
