"""Spark-first operators for corpora of structured, sentence-aligned documents."""
