"""Evidra: evidence retrieval over semi-structured records, written as Spark jobs."""
