"""Road-graph analytics on Spark: columns, operators, sources, plans and queries."""
