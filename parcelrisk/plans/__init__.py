"""Recipes (end-to-end compositions of the operators) and the query
catalog over the benchmark tables."""
