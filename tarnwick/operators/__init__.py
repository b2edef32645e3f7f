"""Registered queries, one or more for each operator of the engine, with equal SQL for DuckDB."""
