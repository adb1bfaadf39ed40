"""tidemark: event-time analytics on Spark DataFrames and Structured Streaming."""
