"""Task-lifecycle analytics on Spark DataFrames."""
