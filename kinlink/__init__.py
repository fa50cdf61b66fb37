"""kinlink: record linkage on Spark DataFrames."""
