"""Queries over the driver tables and the evaluation report."""
