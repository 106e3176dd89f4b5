"""Lap- and sector-timed motorsport telemetry analytics on Spark DataFrames."""
