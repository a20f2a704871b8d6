"""Composed plans: the query registry, DuckDB oracle SQL and job pipelines."""
