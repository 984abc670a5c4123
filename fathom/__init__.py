"""Lexical retrieval and repository analysis on Spark DataFrames."""
