"""Thematic item graphs and annotation consensus as Spark DataFrame jobs."""
