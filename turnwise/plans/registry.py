"""Named queries and their DuckDB counterparts."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a (spark, sf_dir) function under its name, with SQL for the same rows if there is any."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


from turnwise.plans import checks, corpus, curated, learned, more  # noqa: E402, F401  the modules register their queries
