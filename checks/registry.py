"""The registered queries and their SQL."""

from __future__ import annotations

from checks.fixtures import VIEWS, Views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = lambda spark, sf_dir: build(Views(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return build
    return register


class _Plain(dict):
    def __missing__(self, key):
        return key


def with_views(names: str, body: str, extra: str = "") -> str:
    """``body`` after the named fixture views (and ``extra`` CTEs) as a WITH clause."""
    parts = [f"{n} AS ({VIEWS[n].format_map(_Plain())})" for n in names.split()]
    if extra:
        parts.append(extra)
    return f"WITH {', '.join(parts)} {body}"
