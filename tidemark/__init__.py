"""Interval, count and statistics operators on PySpark DataFrames."""
