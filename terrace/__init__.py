"""Ordered-contest analytics as Spark jobs."""
