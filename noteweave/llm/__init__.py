"""Operators for building training data from notes. Nothing outside this package imports it."""
