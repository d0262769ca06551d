"""A table of queries and of their SQL twins, filled by a decorator."""

from __future__ import annotations

from types import SimpleNamespace


def catalog() -> tuple[SimpleNamespace, object]:
    found = SimpleNamespace(QUERIES={}, ORACLES={})

    def query(sql: str | None = None):
        def add(f):
            found.QUERIES[f.__name__] = f
            if sql:
                found.ORACLES[f.__name__] = sql
            return f

        return add

    return found, query
