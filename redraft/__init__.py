"""Document-revision analytics on Spark: DataFrames in, DataFrames out."""
