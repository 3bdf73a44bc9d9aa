"""Readers that turn exports and trees into the engine's relations, and sinks."""
