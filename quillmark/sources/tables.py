"""Versioned Parquet tables: a folder for each version, and a log that names the current ones.

A write goes to a new folder; readers see it with the next entry of the log, which
is one small file that holds the state of all tables and of the catalog.  So a
commit of several tables is one step, a failed write leaves everything as it was,
and there is always an entry to read.  An entry is never replaced: of two writers
that start from the same generation of a table, the second one gets an error.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class ConflictError(RuntimeError):
    """Another writer was first; the statement can be run again."""


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    # --- files by the session's own file system, so any store that Spark reads will do

    def _fs(self, path: str):  # noqa: ANN202
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _put(self, path: str, text: str) -> bool:
        """Writes a new file in one step; False if the place is taken."""
        fs, p = self._fs(path)
        if fs.exists(p):
            return False
        _, part = self._fs(f"{path}.{uuid.uuid4().hex}")
        out = fs.create(part, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not fs.exists(p) and fs.rename(part, p):
            return True
        fs.delete(part, False)
        return False

    def _get(self, path: str) -> str | None:
        fs, p = self._fs(path)
        if not fs.exists(p):
            return None
        source = fs.open(p)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
        finally:
            source.close()

    # --- the log

    def _last(self) -> tuple[int, dict]:
        """The number and content of the newest entry."""
        fs, p = self._fs(f"{self.root}/_log")
        if not fs.exists(p):
            return 0, {"tables": {}, "catalog": {}}
        numbers = [int(n.split(".")[0]) for n in (s.getPath().getName() for s in fs.listStatus(p)) if n.endswith(".json")]
        if not numbers:
            return 0, {"tables": {}, "catalog": {}}
        return max(numbers), json.loads(self._get(f"{self.root}/_log/{max(numbers):012d}.json"))

    def commit(self, change, tries: int = 20) -> dict:  # noqa: ANN001
        """Publishes ``change(state)`` as the next entry; ``change`` may raise, and runs again if another writer was first."""
        for _ in range(tries):
            number, state = self._last()
            change(state)
            if self._put(f"{self.root}/_log/{number + 1:012d}.json", json.dumps(state)):
                return state
        raise ConflictError("the log changes faster than this writer can follow")

    def catalog(self) -> dict:
        return self._last()[1]["catalog"]

    def put_catalog(self, catalog: dict) -> None:
        self.commit(lambda state: state.update(catalog=catalog))

    # --- tables

    def meta(self, name: str) -> dict:
        found = self._last()[1]["tables"].get(name)
        if found is None:
            raise KeyError(f"no table {name}")
        return found

    def exists(self, name: str) -> bool:
        return name in self._last()[1]["tables"]

    def generation(self, name: str) -> int:
        return self.meta(name)["generation"]

    def stage(self, name: str, df: DataFrame, partition_by: list[str] | None = None, sort_by: list[str] | None = None) -> str:
        """Writes a version that nobody reads yet; returns its id."""
        version = uuid.uuid4().hex
        if sort_by:
            df = df.sortWithinPartitions(*sort_by)
        writer = df.write
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(f"{self.root}/{name}/{version}")
        return version

    def activate_all(self, versions: dict[str, tuple[str, str]], expected: dict[str, int] | None = None, catalog: dict | None = None) -> None:
        """Makes versions (id, schema) of several tables current in one step.

        ``expected`` has the generations that the writer has read; a table that is
        at another one is a conflict.
        """

        def change(state: dict) -> None:
            for name, generation in (expected or {}).items():
                if state["tables"].get(name, {"generation": 0})["generation"] != generation:
                    raise ConflictError(f"{name} was written by another writer")
            for name, (version, schema) in versions.items():
                old = state["tables"].get(name, {"generation": 0, "versions": []})
                kept = [v for v in old["versions"] if v != version]
                state["tables"][name] = {"version": version, "generation": old["generation"] + 1, "versions": [*kept, version], "schema": schema}
            if catalog is not None:
                state["catalog"] = catalog

        self.commit(change)

    def activate(self, name: str, version: str, schema: str) -> None:
        self.activate_all({name: (version, schema)})

    def write(self, name: str, df: DataFrame, **layout) -> None:  # noqa: ANN003
        self.activate(name, self.stage(name, df, **layout), df.schema.json())

    def read(self, name: str, version: str | None = None) -> DataFrame:
        from pyspark.sql.types import StructType

        meta = self.meta(name)
        schema = StructType.fromJson(json.loads(meta["schema"]))
        rows = self.spark.read.schema(schema).parquet(f"{self.root}/{name}/{version or meta['version']}")
        return rows.select(*(f"`{c}`" for c in schema.names))

    def drop(self, name: str, if_exists: bool = False) -> None:
        if not self.exists(name):
            if if_exists:
                return
            raise KeyError(f"no table {name}")
        self.commit(lambda state: state["tables"].pop(name, None))
        fs, p = self._fs(f"{self.root}/{name}")
        fs.delete(p, True)

    def drop_version(self, name: str, version: str) -> None:
        if self.meta(name)["version"] == version:
            raise ValueError("the current version cannot be dropped")

        def change(state: dict) -> None:
            own = state["tables"][name]
            own["versions"] = [v for v in own["versions"] if v != version]

        self.commit(change)
        fs, p = self._fs(f"{self.root}/{name}/{version}")
        fs.delete(p, True)

    def names(self) -> list[str]:
        return sorted(self._last()[1]["tables"])

    def backup(self, path: str) -> None:
        """The current version of every table and the catalog, with a manifest, at another place."""
        _, state = self._last()
        for n in state["tables"]:
            self.read(n).write.parquet(f"{path}/{n}")
        manifest = {"tables": {n: m["schema"] for n, m in state["tables"].items()}, "catalog": state["catalog"]}
        if not self._put(f"{path}/manifest.json", json.dumps(manifest)):
            raise FileExistsError(path)

    def restore(self, path: str) -> None:
        """Tables and catalog of a backup, published in one step."""
        from pyspark.sql.types import StructType

        manifest = json.loads(self._get(f"{path}/manifest.json") or '{"tables": {}, "catalog": {}}')
        versions = {}
        for n, schema in manifest["tables"].items():
            versions[n] = self.stage(n, self.spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(f"{path}/{n}")), schema
        self.activate_all(versions, catalog=manifest["catalog"])


def copy_csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    r"""COPY ... FROM a CSV file: \N is null, and a row that does not fit fails the whole load."""
    return spark.read.csv(path, schema=schema, header=header, nullValue=r"\N", mode="FAILFAST", quote='"', escape='"', multiLine=True)
