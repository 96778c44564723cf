"""End-to-end runs built from the operators."""
