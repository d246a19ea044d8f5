"""Sports-tracking analytics on Spark DataFrames."""
