"""Readers of landed data, and table sinks."""
