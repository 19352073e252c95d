"""Operators of the string pipeline."""
