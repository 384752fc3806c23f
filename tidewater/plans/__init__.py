"""Which parts of a query run on which source."""
