"""Column factories: ids, fractions, tags, bits, geodesy."""
