"""Ordered tables, replayable pipelines and sessions."""
