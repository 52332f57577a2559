"""All registered queries of the library's own operators, with their SQL."""

from loomwork.queries import document_queries, keyspace_queries, vector_queries

QUERIES: dict = document_queries.QUERIES | keyspace_queries.QUERIES | vector_queries.QUERIES
SQL: dict = document_queries.SQL | keyspace_queries.SQL | vector_queries.SQL
