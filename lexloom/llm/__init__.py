"""Operators for preparing large text corpora as training data."""
