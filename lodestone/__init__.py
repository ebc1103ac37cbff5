"""Document-collection analytics on DataFrames, Spark SQL and Structured Streaming."""
