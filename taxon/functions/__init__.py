"""Column expressions: no shuffle, no Python worker."""
