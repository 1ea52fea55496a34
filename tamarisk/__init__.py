"""Governed-data and credit-risk analytics as Spark jobs."""
