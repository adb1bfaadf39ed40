"""All event-time queries with their SQL, by name."""

from tidemark.plans import joined, pipelines, stateful, stateless, windowed

PARTS = (pipelines, stateless, windowed, joined, stateful)


def queries() -> dict:
    return {k: v for part in PARTS for k, v in part.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for part in PARTS for k, v in part.SQL.items()}
