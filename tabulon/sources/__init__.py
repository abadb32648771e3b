"""sources of the table engine."""
