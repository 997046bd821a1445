"""Queries over the driver tables, with their SQL."""

from quirelake.plans import derived_queries, file_queries, page_queries, source_queries, store_queries, task_queries, text_queries

QUERIES = text_queries.QUERIES | store_queries.QUERIES | page_queries.QUERIES | task_queries.QUERIES | file_queries.QUERIES | derived_queries.QUERIES | source_queries.QUERIES
ORACLES = text_queries.ORACLES | store_queries.ORACLES | page_queries.ORACLES | task_queries.ORACLES | file_queries.ORACLES | derived_queries.ORACLES | source_queries.ORACLES
