"""Characteristic-sorted portfolios and factor returns as Spark DataFrame jobs."""

__version__ = "0.1.0"
