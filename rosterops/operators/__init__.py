"""Operators: DataFrames and plain parameters in, one lazy DataFrame out."""
