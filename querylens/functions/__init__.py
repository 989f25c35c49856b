"""Column expressions used by the readers, queries and rules."""
