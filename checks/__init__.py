"""Queries over the driver's tables: each runs a library operator, most beside an SQL text that must give the same rows."""
