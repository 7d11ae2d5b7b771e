"""Structured Streaming forms of the checkpointed pipeline."""
