"""Street-network geometry analytics on Spark DataFrames."""
