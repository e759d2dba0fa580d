"""Supervision data from text corpora, as Spark jobs."""
