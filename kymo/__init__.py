"""Kymo: recorded-state analytics on Spark."""
