"""Readers: tables and text extraction from files."""
