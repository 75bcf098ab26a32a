"""Queries over the driver's tables by operator, with their DuckDB oracles."""
