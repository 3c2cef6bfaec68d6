"""Lakehouse operators as plain Spark DataFrame code."""
