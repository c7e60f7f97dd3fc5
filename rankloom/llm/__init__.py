"""Operators for preparing training data, and one query for each."""
