"""Predictive time-series analytics as Spark jobs."""
