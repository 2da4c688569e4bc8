"""Trajectory, geodata and training-text analytics as Spark DataFrame operations."""
