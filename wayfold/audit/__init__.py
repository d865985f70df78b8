"""Contracts, certificates and comparisons of tables."""
