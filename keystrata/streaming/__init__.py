"""Structured Streaming forms of the state fold and of message routing."""
