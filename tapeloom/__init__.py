"""Exchange-tape analytics expressed as Spark DataFrame, SQL and Structured Streaming programs."""
