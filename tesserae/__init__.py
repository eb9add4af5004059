"""Similarity search and metadata curation as Spark DataFrame jobs."""
