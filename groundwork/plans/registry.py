"""Registration of queries with their SQL twins."""

from __future__ import annotations


class Registry:
    """Queries of one lane, and the SQL of those that SQL can express."""

    def __init__(self):
        self.QUERIES: dict = {}
        self.ORACLE: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        def add(f):
            self.QUERIES[name] = f
            if sql:
                self.ORACLE[name] = sql
            return f

        return add
