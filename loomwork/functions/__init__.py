"""Functions of the string pipeline."""
