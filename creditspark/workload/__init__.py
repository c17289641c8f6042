"""Registered queries: every operator over loan-shaped views of the given tables,
each with the same query as SQL."""
