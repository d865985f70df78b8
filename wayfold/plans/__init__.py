"""Queries of the road-graph operators over the supplied tables."""
