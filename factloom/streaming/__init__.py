"""Structured Streaming forms of the operators that carry state."""
