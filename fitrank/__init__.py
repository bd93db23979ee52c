"""Interpretable, deterministic ranking of semi-structured profiles on Spark DataFrames."""
