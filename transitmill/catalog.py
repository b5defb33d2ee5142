"""All registered queries and their SQL."""

from __future__ import annotations

from .plans import answers, feed, pages, placing, streams
from .plans.registry import ORACLES, QUERIES

__all__ = ["answers", "feed", "pages", "placing", "streams", "oracle_sql", "queries"]


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
