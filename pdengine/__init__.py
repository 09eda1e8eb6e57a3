"""Credit-default analytics on Spark DataFrames."""
