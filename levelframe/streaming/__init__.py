"""Structured Streaming twins of the temporal operators."""
