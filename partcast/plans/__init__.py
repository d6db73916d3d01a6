"""Composed plans: the query registry, its DuckDB oracle, and end-to-end flows."""
