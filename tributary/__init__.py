"""Spark-first engine for causally ordered, conflict-prone data."""
