"""plans of the table engine."""
