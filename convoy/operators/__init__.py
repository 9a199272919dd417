"""Batch operators: DataFrame in, DataFrame out."""
