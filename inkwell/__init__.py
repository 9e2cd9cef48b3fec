"""Spark-first analytics over large text corpora and preference retrieval."""
