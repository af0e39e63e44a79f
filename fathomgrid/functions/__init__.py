"""Column expressions (no Python in the data path unless stated)."""
