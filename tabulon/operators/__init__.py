"""operators of the table engine."""
