"""The query registry: one module per family, each with QUERIES and SQL."""
