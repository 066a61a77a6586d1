"""Spark jobs that mine, index and audit text corpora and the tables around them."""
