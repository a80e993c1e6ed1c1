"""Property-level hazard analytics on Spark DataFrames."""
