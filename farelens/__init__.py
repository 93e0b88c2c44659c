"""Taxi-trip analytics as Spark DataFrame plans over a star schema."""

from farelens.sources.schema import TripTables

__all__ = ["TripTables"]
