"""Customer-journey friction analytics on Spark DataFrames."""
