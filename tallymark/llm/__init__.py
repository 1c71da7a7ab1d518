"""Operators that prepare training data. Nothing outside this package imports it."""
