"""Typed scans of the raw exports, and sinks."""
