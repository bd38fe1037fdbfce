"""Streaming forms of batch operators: an extension of this engine."""
