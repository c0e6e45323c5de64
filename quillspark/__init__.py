"""Fidelity-preserving document analytics on Spark DataFrames."""
