"""Operators for preparing large training corpora on Spark."""
