"""loomwork: text-corpus extraction, validation and reconciliation on Spark DataFrames."""
