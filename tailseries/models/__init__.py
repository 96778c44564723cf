"""Weighted forecasters on Spark ML, and the experiments around them."""
