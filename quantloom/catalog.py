"""Every registered panel query with its SQL."""

from __future__ import annotations

from .queries import calendars, cross_sections, evaluations, factors, joins, learning, portfolios, quality, reports, sources, studies, universes  # noqa: F401
from .registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
