"""Streaming forms of the station operators."""
