"""Structured Streaming: live parsing, detection with keyed state, sinks."""
