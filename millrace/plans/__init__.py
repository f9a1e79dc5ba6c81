"""Chains of operators and the work that ends in a new dataset version."""
