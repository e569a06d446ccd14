"""Corpus analytics on Spark DataFrames: sources, text functions, operators and plans over a library of books."""
