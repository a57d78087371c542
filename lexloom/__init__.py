"""Lexloom: document-corpus analytics on Spark DataFrames."""
