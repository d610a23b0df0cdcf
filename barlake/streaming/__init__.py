"""Streaming versions of the bar and indicator operators."""
