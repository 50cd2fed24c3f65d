"""Structured Streaming: event-time windows and stateful limiters."""
