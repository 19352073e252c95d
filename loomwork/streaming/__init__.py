"""Streaming of the string pipeline."""
