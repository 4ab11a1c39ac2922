"""Relational operators that Spark lacks or orders differently."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.scalar import ordering


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order; remaining columns break ties."""
    rest = [F.col(c).asc_nulls_last() for c in df.columns]
    w = Window.partitionBy(*keys).orderBy(*order, *rest)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def top_k(df: DataFrame, order: Sequence[Column], k: int, offset: int = 0) -> DataFrame:
    """ORDER BY with LIMIT and OFFSET, ties broken by all columns."""
    out = df.orderBy(*order, *(F.col(c).asc_nulls_last() for c in df.columns))
    return out.offset(offset).limit(k) if offset else out.limit(k)


def keyset_page(df: DataFrame, key: str, after: object, k: int) -> DataFrame:
    """The next k rows after a key: the filter reaches the scan."""
    return df.filter(F.col(key) > F.lit(after)).orderBy(ordering(F.col(key))).limit(k)


def set_operation(kind: str, left: DataFrame, right: DataFrame) -> DataFrame:
    """UNION, INTERSECT and EXCEPT drop duplicates; columns match by place and take the left names."""
    if len(left.columns) != len(right.columns):
        raise ValueError("set operands differ in width")
    right = right.toDF(*left.columns)
    return {"union all": left.union, "union": lambda r: left.union(r).distinct(), "intersect": left.intersect, "except": left.subtract}[kind.lower()](right)


def set_chain(first: DataFrame, *rest: tuple[str, DataFrame]) -> DataFrame:
    """A chain of set operators, read from the right: a op1 (b op2 c)."""
    operands, kinds = [first, *(d for _, d in rest)], [k for k, _ in rest]
    out = operands.pop()
    while kinds:
        out = set_operation(kinds.pop(), operands.pop(), out)
    return out


def exists(df: DataFrame, condition: Column) -> bool:
    """EXISTS without correlation: one probe for one row."""
    return bool(df.filter(condition).take(1))


def semi(left: DataFrame, right: DataFrame, on: Column, negate: bool = False) -> DataFrame:
    return left.join(right, on, "left_anti" if negate else "left_semi")
