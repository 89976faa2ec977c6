"""Incremental corpus statistics with Structured Streaming."""
