"""Corpus analytics and search on Spark DataFrames."""
