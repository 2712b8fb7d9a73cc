"""Scanpath analytics as DataFrame-in / DataFrame-out operators on Spark."""

__version__ = "0.1.0"
