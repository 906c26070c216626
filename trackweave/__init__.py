"""Trajectory analytics as Spark DataFrame operators."""
