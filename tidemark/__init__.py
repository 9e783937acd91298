"""Point-in-time evidence and event analytics on Spark DataFrames."""
