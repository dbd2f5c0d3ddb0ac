"""Hybrid, graph-aware document retrieval and corpus preparation on Spark DataFrames."""
