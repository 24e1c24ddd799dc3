"""Trajectory analytics and location decisions on PySpark."""
