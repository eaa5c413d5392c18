"""Document processing and analytics on Spark DataFrames."""
