"""lakeward: sensitive-data discovery and access analytics on Spark DataFrames."""
