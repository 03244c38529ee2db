"""Operators over DataFrames of texts and spans."""
