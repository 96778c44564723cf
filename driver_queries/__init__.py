"""The operators applied to the given tables, and the same in SQL."""
