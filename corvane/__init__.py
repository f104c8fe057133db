"""Spark-first engine for retrieval evidence pipelines and corpus preparation."""
