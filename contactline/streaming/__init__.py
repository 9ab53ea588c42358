"""Incremental enrichment with Structured Streaming."""
