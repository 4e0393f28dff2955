"""Structured Streaming jobs over partial results that arrive by site."""
