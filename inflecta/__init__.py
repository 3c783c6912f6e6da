"""Morphology-aware text comparison on Spark DataFrames."""
