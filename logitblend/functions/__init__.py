"""Column expressions: no DataFrame, no shuffle, no Python per row."""
