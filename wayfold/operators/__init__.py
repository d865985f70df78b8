"""Relational, graph, geometry and audit operators over DataFrames."""
