"""Streaming counters."""
