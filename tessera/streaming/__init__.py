"""Structured Streaming forms of the event-driven operators; event time and watermarks are explicit."""
