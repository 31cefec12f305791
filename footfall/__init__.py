"""footfall: multi-tenant web event analytics on Spark DataFrames and Structured Streaming."""
