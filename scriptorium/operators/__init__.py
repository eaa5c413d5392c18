"""Operators: functions from DataFrames to DataFrames.  Order is always a column, never the order of rows."""
