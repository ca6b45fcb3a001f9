"""Regional product-affinity analytics on Spark DataFrames."""
