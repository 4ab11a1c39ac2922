"""Recursive queries as fixpoints over settled frontiers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from quillmark.sources.shared import settle

DEPTH_LIMIT = 64


def fixpoint(anchor: DataFrame, step: Callable[[DataFrame], DataFrame], distinct: bool = True, limit: int = DEPTH_LIMIT) -> DataFrame:
    """WITH RECURSIVE: UNION when ``distinct``, else UNION ALL.

    Each round reads the last round's new rows only; with UNION, rows that were
    seen before do not come back, so cycles end.  More rounds than ``limit`` are an
    error.
    """
    seen = settle(anchor.distinct() if distinct else anchor)
    frontier = seen
    for _ in range(limit):
        new = step(frontier).toDF(*anchor.columns)
        if distinct:
            same = [new[c].eqNullSafe(seen[c]) for c in anchor.columns]
            new = new.distinct().join(seen, same, "left_anti")
        new = settle(new)
        if not new.take(1):
            return seen
        seen, frontier = seen.union(new), new
    raise RecursionError(f"a recursive query went beyond {limit} rounds")
