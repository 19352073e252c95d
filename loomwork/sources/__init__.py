"""Sources of the string pipeline."""
