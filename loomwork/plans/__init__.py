"""Plans of the string pipeline."""
