"""Materialized projections: versions, hashes, diffs, repair plans and query substitution."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.sources.tables import Store

VOLATILE = re.compile(r"\b(rand|randn|random|uuid|now|current_timestamp|current_date|shuffle|monotonically_increasing_id|spark_partition_id|nextval)\s*\(", re.I)
MODES = ("metadata_only", "hashes_only", "indexes_only", "full")


def row_digest(columns: Sequence[str]) -> Column:
    """SHA-256 of a row's values, nulls told apart from texts."""
    return F.sha2(F.to_json(F.struct(*(F.col(c).cast("string").alias(c) for c in columns)), {"ignoreNullFields": "false"}), 256)


def digests(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """row_id (the key columns as text) and digest of each row."""
    return df.select(F.concat_ws("\u001f", *(F.col(k).cast("string") for k in keys)).alias("row_id"), row_digest(sorted(df.columns)).alias("digest"))


def root_digest(df: DataFrame) -> str:
    """One digest of all rows that does not depend on their order: sums of digest halves, with the count."""
    d = df.select(row_digest(sorted(df.columns)).alias("d"))
    parts = [F.sum(F.conv(F.substring("d", 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(5)]
    r = d.agg(F.count(F.lit(1)).alias("n"), *parts).first()
    return "-".join(str(x or 0) for x in r)


def diff(left: DataFrame, right: DataFrame, keys: Sequence[str], limit: int | None = None, after: str | None = None) -> DataFrame:
    """Rows that were added, removed or changed from left to right, in the order of row_id."""
    a, b = digests(left, keys), digests(right, keys)
    a, b = (x.withColumnsRenamed({"row_id": f"{n}_id", "digest": f"{n}_digest"}) for x, n in ((a, "left"), (b, "right")))
    both = a.join(b, F.col("left_id") == F.col("right_id"), "full_outer")
    change = F.when(F.col("left_id").isNull(), "added").when(F.col("right_id").isNull(), "removed").when(F.col("left_digest") != F.col("right_digest"), "changed")
    out = both.select(F.coalesce("left_id", "right_id").alias("row_id"), change.alias("change"), "left_digest", "right_digest").filter("change is not null")
    if after is not None:
        out = out.filter(F.col("row_id") > after)
    return out.orderBy("row_id").limit(limit) if limit is not None else out


def diff_page(left: DataFrame, right: DataFrame, keys: Sequence[str], limit: int, after: str | None = None) -> DataFrame:
    """A page of ``diff``: next_cursor is the row to go on after, null on the last page, and complete tells so."""
    page = diff(left, right, keys, limit + 1, after)
    rows = page.withColumn("__n", F.row_number().over(Window.orderBy("row_id")))
    total = F.max("__n").over(Window.partitionBy())
    last = F.max(F.when(F.col("__n") <= limit, F.col("row_id"))).over(Window.partitionBy())
    rows = rows.withColumns({"complete": total <= limit, "next_cursor": F.when(total > limit, last)})
    return rows.filter(F.col("__n") <= limit).drop("__n")


@dataclass
class Projection:
    name: str
    sql: str
    sources: tuple[str, ...]
    build: Callable[[], DataFrame]
    columns: tuple[str, ...] = ()
    generations: dict[str, int] = field(default_factory=dict)
    versions: dict[str, dict] = field(default_factory=dict)
    current: str = ""
    layout: dict[str, list[str] | None] = field(default_factory=dict)


class Projections:
    """Stored queries with versioned results over a store's tables."""

    def __init__(self, store: Store) -> None:
        self.store = store
        self.known: dict[str, Projection] = {}

    def create(self, name: str, sql: str, sources: Sequence[str], run: Callable[[str], DataFrame], partition_by: list[str] | None = None, sort_by: list[str] | None = None) -> Projection:
        if name in self.known:
            raise ValueError(f"projection {name} exists")
        if VOLATILE.search(sql):
            raise ValueError("a projection's query must be deterministic")
        p = Projection(name, sql, tuple(sources), lambda: run(sql))
        self.known[name] = p
        p.layout = {"partition_by": partition_by, "sort_by": sort_by}
        self.activate(name, self.build_version(name))
        return p

    def build_version(self, name: str) -> str:
        """Builds a version beside the current one."""
        p = self.known[name]
        generations = {s: self.store.generation(s) for s in p.sources}
        df = p.build()
        version = self.store.stage(f"projection_{name}", df, **p.layout)
        stored = self.store.spark.read.schema(df.schema).parquet(f"{self.store.root}/projection_{name}/{version}")
        p.versions[version] = {"root": root_digest(stored), "rows": stored.count(), "generations": generations, "schema": df.schema.json(), "columns": tuple(df.columns)}
        return version

    def activate(self, name: str, version: str, unsafe: bool = False) -> None:
        p = self.known[name]
        meta = p.versions[version]
        if not unsafe and not self.verify(name, "hashes_only", version)["ok"]:
            raise ValueError("the version does not match its hashes")
        self.store.activate(f"projection_{name}", version, meta["schema"])
        p.current, p.generations, p.columns = version, meta["generations"], meta["columns"]

    def refresh(self, name: str) -> None:
        self.activate(name, self.build_version(name))

    def drop(self, name: str) -> None:
        del self.known[name]
        self.store.drop(f"projection_{name}")

    def drop_version(self, name: str, version: str) -> None:
        self.store.drop_version(f"projection_{name}", version)
        del self.known[name].versions[version]

    def stale(self, name: str) -> bool:
        p = self.known[name]
        return any(self.store.generation(s) != g for s, g in p.generations.items())

    def read(self, name: str, version: str | None = None) -> DataFrame:
        return self.store.read(f"projection_{name}", version)

    def verify(self, name: str, mode: str = "full", version: str | None = None) -> dict:
        """Holds a version against its recorded rows and root digest, and in full mode against its query."""
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode}")
        p = self.known[name]
        version = version or p.current
        meta = p.versions[version]
        out = {"projection": name, "version": version, "mode": mode, "ok": True, "rows": meta["rows"]}
        place = f"{self.store.root}/projection_{name}/{version}"
        if mode in ("metadata_only", "full"):
            found = self.store.spark.read.parquet(place) if meta["rows"] else self.store.read(f"projection_{name}", version)
            same = set(found.columns) == set(meta["columns"])
            out["ok"] = same and found.count() == meta["rows"]
        if mode in ("indexes_only", "full") and p.layout.get("partition_by"):
            folders = {c for f in self.store.spark.read.parquet(place).inputFiles() for c in re.findall(r"/([^/=]+)=", f)}
            out["ok"] = out["ok"] and set(p.layout["partition_by"]) <= folders
        if mode in ("hashes_only", "full") and out["ok"]:
            df = self.store.spark.read.schema(_schema(meta["schema"])).parquet(f"{self.store.root}/projection_{name}/{version}")
            out["root"] = root_digest(df)
            out["ok"] = out["root"] == meta["root"]
        if mode == "full" and out["ok"] and not self.stale(name):
            out["ok"] = root_digest(p.build()) == meta["root"]
        return out

    def manifest(self, name: str) -> dict:
        p = self.known[name]
        meta = p.versions[p.current]
        return {"projection": name, "version": p.current, "rows": meta["rows"], "root": meta["root"], "sources": dict(p.generations)}

    def compare(self, name: str, manifest: dict) -> dict:
        own = self.manifest(name)
        return {"matches": own["root"] == manifest["root"] and own["rows"] == manifest["rows"], "root": own["root"], "other_root": manifest["root"]}

    def plan_repair(self, name: str, scope: str = "full_rebuild") -> dict:
        if scope not in ("row", "range", "index", "projection_version", "full_rebuild"):
            raise ValueError(f"unknown scope {scope}")
        ok = self.verify(name, "hashes_only")["ok"] and not self.stale(name)
        return {"projection": name, "scope": scope, "needed": not ok, "action": "none" if ok else "rebuild"}

    def repair(self, name: str, scope: str = "full_rebuild") -> dict:
        plan = self.plan_repair(name, scope)
        if plan["needed"]:
            self.refresh(name)
        return plan

    def substitute(self, source: str, columns: Sequence[str]) -> tuple[DataFrame, str | None]:
        """The table, or a fresh one-source projection that has all the wanted columns."""
        for p in self.known.values():
            plain = re.fullmatch(r"\s*select\s+[\w\s,]+\s+from\s+(\w+)\s*", p.sql, re.I)
            if plain and plain[1] == source and set(columns) <= set(p.columns) and not self.stale(p.name):
                return self.read(p.name).select(*columns), p.name
        return self.store.read(source).select(*columns), None


def _schema(text: str):  # noqa: ANN202
    import json

    from pyspark.sql.types import StructType

    return StructType.fromJson(json.loads(text))
