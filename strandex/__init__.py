"""Strandex: document evidence search and processing on Spark."""
