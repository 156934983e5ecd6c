"""Sparse-volume and surface analytics expressed as Spark DataFrame operators."""
