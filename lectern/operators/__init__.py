"""Operators over books, pages, definitions and citations."""
