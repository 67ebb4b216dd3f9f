"""All registered queries of the library's own operators."""

from __future__ import annotations

from . import evaluation, geometry, prompts, scenes, selection, sinks, texts  # noqa: F401  (they register their queries)
from .registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
