"""Network path and latency analytics on Spark DataFrames."""
