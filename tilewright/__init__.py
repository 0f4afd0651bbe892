"""Compressed-tile analytics on Spark."""
