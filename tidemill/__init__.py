"""Ranking, interaction and retrieval analytics on Spark DataFrames."""
