"""Operators for training data; optional, nothing else in the package imports them."""
