"""Preparation and evaluation of stand-off-annotated text on Spark."""

__version__ = "0.1.0"
