"""Corpus analytics on Spark: DataFrame operators for text corpora."""
