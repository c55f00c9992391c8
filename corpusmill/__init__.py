"""Corpus preparation, retrieval and chat analytics on Spark DataFrames."""
