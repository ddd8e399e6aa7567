"""Column functions: labels, keys, reply text and JSON."""
