"""DataFrame operators. Each takes explicit series keys and scales with their number."""
