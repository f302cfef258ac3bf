"""lumenframe: labelled-array analytics on Spark DataFrames."""
