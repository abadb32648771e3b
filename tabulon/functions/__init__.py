"""functions of the table engine."""
