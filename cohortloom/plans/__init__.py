"""Composed jobs, and the queries registered on the benchmark tables."""
