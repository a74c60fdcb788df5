"""Conversational-memory analytics as Spark DataFrame and Structured Streaming jobs."""
