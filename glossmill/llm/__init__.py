"""Operators that clean and shape text for model training. Nothing outside this package imports it."""
