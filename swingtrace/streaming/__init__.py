"""Structured Streaming versions of the rollups, watches and sessions."""
