"""Structured Streaming forms of the profiling operators."""
