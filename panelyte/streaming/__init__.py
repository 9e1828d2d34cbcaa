"""Structured Streaming: bars from events and daily increments."""
