"""Operators over DataFrames; each states its key, its shuffles and its behaviour on odd input."""
