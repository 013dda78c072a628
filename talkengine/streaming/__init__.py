"""Structured Streaming: incremental, resumable scoring."""
