"""Driver-table adapters and the query registry."""
