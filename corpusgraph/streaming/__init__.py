"""Structured Streaming jobs: folder watch, settle windows, index upkeep."""
