"""Streaming of the engine: an extension beyond the batch operators."""
