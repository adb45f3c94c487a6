"""Retrieval, evidence, evaluation and data preparation over document corpora, on Spark DataFrames."""
