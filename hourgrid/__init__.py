"""Hourly event tables, and judging the scores made from them, on Spark."""
