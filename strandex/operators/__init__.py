"""Relational and search operators on DataFrames."""
