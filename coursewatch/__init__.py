"""Change detection and scheduling analytics over dated items, on Spark DataFrames."""
