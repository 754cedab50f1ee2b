"""All queries of the library; importing a module registers its own."""

from __future__ import annotations

from leadlens.catalog import buyers, domain, feeds, graph, reading, relational, scoring, spine, stories, streams, temporal, textual, tree, work  # noqa: F401
from leadlens.registry import QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in QUERIES.items() if q.sql}
