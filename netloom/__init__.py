"""Transportation-network analytics on Spark DataFrames."""
