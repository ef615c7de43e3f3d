"""Swingtrace: why did a metric move? Root-cause analytics as Spark DataFrame jobs."""
