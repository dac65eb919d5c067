"""Tidemark: market-event, panel and study operators on the DataFrame, SQL and Structured Streaming APIs."""
