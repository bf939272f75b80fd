"""Recordings as sources and sinks."""
