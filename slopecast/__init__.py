"""Terrain-and-rainfall hazard analytics as Spark DataFrame operators."""
