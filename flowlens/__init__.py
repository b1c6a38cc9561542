"""Personal-data flow analytics on Spark DataFrames."""
