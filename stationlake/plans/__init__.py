"""Logical-plan rewrites for joins that Spark has no operator for."""
