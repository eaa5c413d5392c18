"""Readers and writers.  Files are read by Spark's own sources, so any store that Spark reaches will do."""
