"""Time buckets stored as rollups, their use in queries, and retention."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.scalar import micros, time_bucket
from quillmark.sources.tables import Store


@dataclass(frozen=True)
class Rollup:
    """A stored aggregate: bucket width and time column, keys, ordered aggregates, filter."""

    name: str
    source: str
    width: str
    time: str
    keys: tuple[str, ...]
    aggregates: tuple[tuple[str, str, str], ...]
    where: str | None = None

    def build(self, df: DataFrame) -> DataFrame:
        """``bucket``, the keys and the aggregates (function, column, name) of the source."""
        if self.where:
            df = df.filter(self.where)
        call = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
        aggs = [call[f](F.lit(1) if c == "*" else F.col(c)).alias(n) for f, c, n in self.aggregates]
        return df.groupBy(time_bucket(self.width, F.col(self.time)).alias("bucket"), *self.keys).agg(*aggs)

    def answers(self, other: Rollup) -> bool:
        """Whether its rows are the answer to a query of the other's shape."""
        return (self.source, self.width, self.time, self.keys, self.aggregates, self.where) == (other.source, other.width, other.time, other.keys, other.aggregates, other.where)


@dataclass
class Rollups:
    """Rollups of a store; each remembers the generation of its source that it was built from."""

    store: Store
    known: dict[str, tuple[Rollup, int]] = field(default_factory=dict)

    def create(self, rollup: Rollup) -> None:
        if rollup.name in self.known:
            raise ValueError(f"rollup {rollup.name} exists")
        self._write(rollup)

    def _write(self, rollup: Rollup) -> None:
        generation = self.store.generation(rollup.source)
        self.store.write(f"rollup_{rollup.name}", rollup.build(self.store.read(rollup.source)))
        self.known[rollup.name] = rollup, generation

    def refresh(self, name: str) -> None:
        self._write(self.known[name][0])

    def drop(self, name: str, if_exists: bool = False) -> None:
        if name not in self.known and not if_exists:
            raise KeyError(name)
        if self.known.pop(name, None):
            self.store.drop(f"rollup_{name}")

    def fresh(self, name: str) -> bool:
        rollup, generation = self.known[name]
        return self.store.generation(rollup.source) == generation

    def after_write(self, source: str) -> None:
        """Brings the rollups of a source up to date, as a committed write does."""
        for name, (rollup, _) in list(self.known.items()):
            if rollup.source == source:
                self.refresh(name)

    def query(self, wanted: Rollup) -> tuple[DataFrame, str | None]:
        """The rows of a query and the rollup that gave them, if a fresh one matches exactly."""
        for name, (rollup, _) in self.known.items():
            if rollup.answers(wanted) and self.fresh(name):
                return self.store.read(f"rollup_{name}"), name
        return wanted.build(self.store.read(wanted.source)), None


def retention(df: DataFrame, time: str, retain_for: str, at: str) -> tuple[DataFrame, DataFrame]:
    """Rows that stay, and one row of counts (deleted, kept, skipped).

    Rows older than ``at`` less the duration go; those whose time is missing or
    cannot be read stay and count as skipped.
    """
    ts = F.try_to_timestamp(F.col(time).cast("string"))
    cutoff = F.timestamp_micros(F.unix_micros(F.lit(at).cast("timestamp")) - micros(retain_for))
    old = F.coalesce(ts < cutoff, F.lit(False))
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    counts = df.agg(n(old).alias("deleted"), n(~old & ts.isNotNull()).alias("kept"), n(ts.isNull()).alias("skipped"))
    return df.filter(~old), counts


def time_range(df: DataFrame, time: str, start: str, end: str, partition: dict[str, object] | None = None) -> DataFrame:
    """Rows of [start, end) and the given partition keys; both reach the scan as filters."""
    cond: Column = (F.col(time) >= F.lit(start).cast("timestamp_ntz")) & (F.col(time) < F.lit(end).cast("timestamp_ntz"))
    for k, v in (partition or {}).items():
        cond = cond & (F.col(k) == F.lit(v))
    return df.filter(cond)


def write_partitioned(df: DataFrame, path: str, time: str, keys: Sequence[str] = (), files: int = 8) -> None:
    """The layout of a time-series index: a folder for each key and day, sorted by time inside.

    A folder's rows go to up to ``files`` tasks by a hash of their time, so a day or
    key with most of the rows does not meet in one.
    """
    salt = F.pmod(F.xxhash64(F.col(time)), F.lit(files))
    df.withColumn("day", F.to_date(time)).repartition(*keys, "day", salt).sortWithinPartitions(*keys, "day", time).write.partitionBy(*keys, "day").parquet(path)
