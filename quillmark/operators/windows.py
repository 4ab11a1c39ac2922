"""Window frames: explicit ROWS, peers by GROUPS, and EXCLUDE, which Spark's SQL has not."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = Window.unboundedPreceding, Window.unboundedFollowing


def rows(partition: Sequence[str], order: Sequence[Column], start: int = START, end: int = 0) -> Window:
    """The default frame of the dialect: ROWS from the start of the partition to the current row."""
    return Window.partitionBy(*partition).orderBy(*order).rowsBetween(start, end)


def _edge(n: int | None, side: str) -> str:
    return f"UNBOUNDED {side}" if n is None else "CURRENT ROW" if n == 0 else f"{abs(n)} {'PRECEDING' if n < 0 else 'FOLLOWING'}"


def _least(a: int | None, b: int) -> int:
    return b if a is None else min(a, b)


def _most(a: int | None, b: int) -> int:
    return b if a is None else max(a, b)


def pick(kind: str, value: str, partition: str, order: str, g: str, r: str, unit: str, low: int | None, high: int | None, exclude: str, levels: tuple[list[str], list[str]] | None = None) -> str:
    """SQL of ``first_value``, ``last_value`` or ``min`` over a frame with an exclusion.

    ``g`` numbers the peers and ``r`` the rows of a partition.  A frame without some
    of its rows is one or more plain frames: those before, those after, and what
    stays of the current group; the value with the first or last row number of them
    is picked, so no frame is ever gathered.  Only RANGE frames and ROWS frames
    without the current row's peers gather their rows.  ``levels`` gets columns of
    two nested queries, what is compared and the plain frames, so windows share
    them; else they stand in the text.
    """

    def below(text: str, level: int) -> str:
        if levels is None:
            return text
        if text not in levels[level]:
            levels[level].append(text)
        return f"__{'ip'[level]}{levels[level].index(text)}"

    call = {"first_value": "min", "last_value": "max", "min": "min"}[kind]
    item = value if kind == "min" else f"struct({r} AS r, {value} AS v)"
    parted = f"PARTITION BY {partition}" if partition else ""

    def over(frame: str, by: str, extra: str = "") -> str:
        return f"{call}({below(item, 0)}) OVER (PARTITION BY {', '.join(x for x in (partition, extra) if x)} ORDER BY {by} {frame})" if partition or extra else f"{call}({below(item, 0)}) OVER (ORDER BY {by} {frame})"

    between = lambda a, b, u: f"{u} BETWEEN {_edge(a, 'PRECEDING')} AND {_edge(b, 'FOLLOWING')}"

    def piece(a: int | None, b: int | None, by: str, u: str, extra: str = "") -> str:
        """A frame; one that reaches from some place to the end is read from the end, as Spark would go through what follows for each row."""
        if b is None and a is not None:
            return below(over(between(None, -a, u), f"{by} DESC", extra), 1)
        return below(over(between(a, b, u), by, extra), 1)

    inside = (low is None or low <= 0) and (high is None or high >= 0)
    pieces: list[str] | None = None
    if unit == "groups" or unit == "rows" and exclude in ("no others", "current row"):
        by, kind_of = (g, "RANGE") if unit == "groups" else (r, "ROWS")
        if exclude == "no others":
            pieces = [piece(low, high, by, kind_of)]
        else:
            pieces = []
            if low is None or low < 0:
                pieces.append(piece(low, _least(high, -1), by, kind_of))
            if high is None or high > 0:
                pieces.append(piece(_most(low, 1), high, by, kind_of))
            if unit == "groups" and inside and exclude == "current row":
                pieces += [piece(None, -1, r, "ROWS", g), piece(1, None, r, "ROWS", g)]
            elif unit == "groups" and inside and exclude == "ties":
                pieces.append(below(item, 0))
    if pieces is not None:
        if not pieces:
            return f"IF(true, NULL, {value})"
        chosen = pieces[0] if len(pieces) == 1 else f"{'least' if call == 'min' else 'greatest'}({', '.join(pieces)})"
        return chosen if kind == "min" else f"({chosen}).v"
    frame = between(low, high, unit.upper())
    seen = f"collect_list(struct({r} AS r, {g} AS g, {value} AS v)) OVER ({parted} ORDER BY {order} {frame})"
    keep = {"no others": "true", "current row": f"x.r <> {r}", "group": f"x.g <> {g}", "ties": f"(x.g <> {g} OR x.r = {r})"}[exclude]
    left = f"array_sort(filter({seen}, x -> {keep}))"
    return {"first_value": f"get({left}, 0).v", "last_value": f"try_element_at({left}, -1).v", "min": f"array_min(transform({left}, x -> x.v))"}[kind]


def over_groups(df: DataFrame, partition: Sequence[str], order: Sequence[Column], value: str, name: str, start: int, end: int, kind: str = "first_value", exclude: str = "no others") -> DataFrame:
    """``first_value``, ``last_value`` or ``min`` over a GROUPS frame, with an exclusion."""
    by = Window.partitionBy(*partition)
    ties = [F.col(c).asc_nulls_last() for c in df.columns]
    out = df.withColumns({"__g": F.dense_rank().over(by.orderBy(*order)), "__r": F.row_number().over(by.orderBy(*order, *ties))})
    offset = lambda n: None if abs(n) >= 1 << 31 else n
    text = pick(kind, f"`{value}`", ", ".join(f"`{c}`" for c in partition), "__r", "__g", "__r", "groups", offset(start), offset(end), exclude)
    return out.withColumn(name, F.expr(text)).drop("__g", "__r")
