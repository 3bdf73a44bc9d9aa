"""Commit aggregates over a streaming ``commits`` relation."""
