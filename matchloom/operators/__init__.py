"""Operators: DataFrame in, DataFrame out, keyed by ids."""
