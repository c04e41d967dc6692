"""Structured Streaming forms of some operators."""
