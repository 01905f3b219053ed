"""Meter analytics and agent-episode evaluation as PySpark DataFrame jobs."""
