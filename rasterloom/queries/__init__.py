"""Queries over the views, one per operator, with DuckDB counterparts."""
