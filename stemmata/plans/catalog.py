"""All named queries of the engine itself; importing the modules registers them."""

from __future__ import annotations

from . import cases, evidence, facts, lineage, outside, population, relational, texts, timeline  # noqa: F401
from .registry import QUERIES, SQL, Query

FLAGSHIP = "q00_spread_and_survival"


def queries() -> dict[str, Query]:
    return {FLAGSHIP: QUERIES[FLAGSHIP], **dict(sorted(QUERIES.items()))}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
