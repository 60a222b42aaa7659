"""The register of page queries and their DuckDB SQL, with SQL they share."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


COUNT = "CAST((length(html) - length(replace(html, '{0}', ''))) / {1} AS BIGINT)"
HOST = r"nullif(regexp_extract(url, '^https?://(?:www\.|w[0-9]+\.)?([^/]+)', 1), '')"
