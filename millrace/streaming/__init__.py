"""Checkpointed append streams."""
