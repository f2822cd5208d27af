"""Text and experience analytics on Spark DataFrames."""
