"""Rare-event analysis of irregular environmental time series on Spark."""

__version__ = "0.1.0"
