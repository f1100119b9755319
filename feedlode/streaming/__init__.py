"""Structured Streaming: de-duplication, the insight store and live results."""
