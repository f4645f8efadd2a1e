"""Retail order and inventory analytics as Spark DataFrame operators."""
