"""The queries over the driver's tables, and their SQL."""

from . import layout_queries, service_queries, text_queries, upkeep_queries

QUERIES = {**text_queries.QUERIES, **layout_queries.QUERIES, **service_queries.QUERIES, **upkeep_queries.QUERIES}
SQL = {**text_queries.SQL, **layout_queries.SQL, **service_queries.SQL, **upkeep_queries.SQL}
flagship = text_queries.flagship
