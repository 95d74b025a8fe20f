"""Structured Streaming intake (webhook deliveries) and streaming counters."""
