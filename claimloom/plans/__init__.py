"""Driver-facing queries with their SQL twins."""
