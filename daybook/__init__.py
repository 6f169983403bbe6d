"""Work-log analytics on Spark: every job takes DataFrames and returns a DataFrame."""
