"""Operators for preparing text as training data. Nothing outside this package imports it."""
