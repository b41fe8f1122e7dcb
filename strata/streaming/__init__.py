"""Structured Streaming: new files to silver, ticks to bars, deduplication of events."""
