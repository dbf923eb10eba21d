"""Queries of the library by name, with DuckDB SQL for each that SQL can express."""

from . import grid_queries, image_queries, inference_queries

QUERIES = grid_queries.QUERIES | inference_queries.QUERIES | image_queries.QUERIES
ORACLE_SQL = grid_queries.ORACLE_SQL | inference_queries.ORACLE_SQL | image_queries.ORACLE_SQL
