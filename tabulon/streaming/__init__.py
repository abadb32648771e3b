"""streaming of the table engine."""
