"""Differentially private analytics and learning on Spark DataFrames."""

__version__ = "0.1.0"
