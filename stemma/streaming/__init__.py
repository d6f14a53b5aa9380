"""Structured Streaming pipelines over growing logs and event tables."""
