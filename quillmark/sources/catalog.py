"""Tables with constraints, DML, transactions and a virtual catalog, over versioned Parquet."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillmark.functions.search import Analyzer
from quillmark.functions.session import Session
from quillmark.plans.tree import Group, Token, parse, render, words
from quillmark.session import Queries, configure
from quillmark.sources.shared import settle
from quillmark.sources.tables import Store


class ConstraintError(ValueError):
    pass


@dataclass
class ForeignKey:
    column: str
    table: str
    target: str
    on_delete: str = "no action"
    on_update: str = "no action"


@dataclass
class Table:
    name: str
    schema: StructType
    primary_key: tuple[str, ...] = ()
    unique: list[tuple[str, ...]] = field(default_factory=list)
    not_null: set[str] = field(default_factory=set)
    checks: list[str] = field(default_factory=list)
    defaults: dict[str, str] = field(default_factory=dict)
    foreign_keys: list[ForeignKey] = field(default_factory=list)


class Database(Queries):
    """Statements stage whole new versions, check them with queries, and publish them together.

    Definitions are kept in the store's log, so a database opened again has them.
    """

    def __init__(self, store: Store) -> None:
        self.store, self.spark, self.session = store, store.spark, Session()
        configure(self.spark)
        self.tables: dict[str, Table] = {}
        self.views: dict[str, str] = {}
        self.sequences: dict[str, int] = {}
        self.indexes: dict[str, dict] = {}
        self.functions: dict[str, list[str]] = {}
        self.procedures: dict[str, str] = {}
        self.schemas: list[str] = ["public"]
        self.graphs: dict[str, dict] = {}
        self.policies: dict[str, dict] = {}
        self.staged: list[dict[str, DataFrame]] = []
        self.savepoints: list[tuple[str, int]] = []
        self.listeners: list = []
        self.seen: dict[str, int] = {}
        self._load(store.catalog())

    @property
    def settings(self) -> dict[str, str]:
        return self.session.settings

    # --- the catalog in the store

    def _load(self, found: dict) -> None:
        for n, t in found.get("tables", {}).items():
            keys = [ForeignKey(**f) for f in t["foreign_keys"]]
            self.tables[n] = Table(n, StructType.fromJson(json.loads(t["schema"])), tuple(t["primary_key"]), [tuple(u) for u in t["unique"]], set(t["not_null"]), t["checks"], t["defaults"], keys)
        for k in ("views", "sequences", "indexes", "procedures", "graphs", "policies"):
            getattr(self, k).update(found.get(k, {}))
        self.schemas = found.get("schemas", self.schemas)
        for n, (params, returns, body) in found.get("functions", {}).items():
            self.create_function(n, params, returns, body, keep=False)

    def saved(self) -> dict:
        tables = {n: {"schema": t.schema.json(), "primary_key": list(t.primary_key), "unique": [list(u) for u in t.unique], "not_null": sorted(t.not_null), "checks": t.checks, "defaults": t.defaults, "foreign_keys": [asdict(f) for f in t.foreign_keys]} for n, t in self.tables.items()}
        return {"tables": tables, **{k: getattr(self, k) for k in ("views", "sequences", "indexes", "functions", "procedures", "schemas", "graphs", "policies")}}

    def save(self) -> None:
        """Publishes the definitions as they are now."""
        self.store.put_catalog(self.saved())

    # --- what queries look up

    def table(self, name: str) -> DataFrame:
        return self.read(name)

    def table_names(self) -> set[str]:
        """Tables, views, and stored outputs of rollups and projections by the names of these."""
        outputs = {n.split("_", 1)[1] for n in self.store.names() if n.startswith(("rollup_", "projection_"))}
        return self.tables.keys() | self.views.keys() | outputs

    def edges(self, graph_name: str) -> DataFrame:
        if graph_name not in self.graphs:
            return self.read(graph_name)
        return self.read(f"{graph_name}_edges")

    def search_options(self, table: str | None, field_name: str) -> tuple[Analyzer, dict]:
        for i in self.indexes.values():
            if i["table"] == table and i["kind"] == "fulltext" and field_name in i["columns"]:
                o = {k.lower(): str(v).lower() for k, v in i.get("options", {}).items()}
                analyzer = Analyzer(whitespace=o.get("tokenizer") == "whitespace" or o.get("analyzer") == "whitespace", case_folding=o.get("case_folding", "true") != "false", stop_words=o.get("stop_words", "true") not in ("false", "none") and o.get("analyzer") != "simple", accent_folding=o.get("accent_folding", "false") == "true")
                return analyzer, {k: float(o[k]) for k in ("k1", "b", "boost") if k in o}
        return Analyzer(), {}

    def execute(self, text: str, args: list | None = None) -> DataFrame | None:
        """Any statement of the dialect; rows where it has some."""
        from quillmark.plans.statements import Statements

        return Statements(self).run(text, args)

    # --- definitions

    def create_table(self, name: str, ddl: str, if_not_exists: bool = False, **constraints) -> None:  # noqa: ANN003
        if name in self.tables:
            if if_not_exists:
                return
            raise ValueError(f"table {name} exists")
        empty = self.spark.createDataFrame([], ddl)
        self.tables[name] = Table(name, empty.schema, **constraints)
        self.store.write(name, empty)
        self.save()

    def drop_table(self, name: str, if_exists: bool = False) -> None:
        if self.tables.pop(name, None) is None and not if_exists:
            raise KeyError(name)
        self.store.drop(name, if_exists=True)
        self.save()

    def alter_add(self, name: str, column: str, kind: str, default: str | None = None) -> None:
        df = self.read(name).withColumn(column, (F.expr(default) if default else F.lit(None)).cast(kind))
        if default:
            self.tables[name].defaults[column] = default
        self._redefine(name, df)

    def alter_drop(self, name: str, column: str) -> None:
        """Drops a column; one that a key, a check or a foreign key needs stays."""
        t = self.tables[name]
        used = {*t.primary_key, *(c for u in t.unique for c in u), *(c for x in t.checks for c in words(parse(x))), *(f.column for f in t.foreign_keys)}
        if column in used:
            raise ConstraintError(f"{name}.{column} is part of a constraint")
        t.not_null.discard(column)
        t.defaults.pop(column, None)
        self._redefine(name, self.read(name).drop(column))

    def alter_rename(self, name: str, column: str, to: str) -> None:
        """Renames a column in the table and in all its rules."""
        t, df = self.tables[name], self.read(name).withColumnRenamed(column, to)
        new = lambda c: to if c == column else c
        t.primary_key, t.unique = tuple(map(new, t.primary_key)), [tuple(map(new, u)) for u in t.unique]
        t.not_null, t.defaults = set(map(new, t.not_null)), {new(k): v for k, v in t.defaults.items()}
        t.checks = [render(renamed(parse(c), column, to)) for c in t.checks]
        for own in self.tables.values():
            for f in own.foreign_keys:
                f.column = new(f.column) if own.name == name else f.column
                f.target = new(f.target) if f.table == name else f.target
        for i in self.indexes.values():
            i["columns"] = [new(c) if i["table"] == name else c for c in i["columns"]]
        self._redefine(name, df)

    def rename_table(self, name: str, to: str) -> None:
        df = self.read(name)
        self.tables[to] = self.tables.pop(name)
        self.tables[to].name = to
        self.store.write(to, df)
        self.store.drop(name)
        self.save()

    def _redefine(self, name: str, df: DataFrame) -> None:
        self.store.write(name, df)
        self.tables[name].schema = df.schema
        self.save()

    def add_constraint(self, name: str, primary_key: tuple[str, ...] = (), unique: tuple[str, ...] = (), check: str | None = None, foreign_key: ForeignKey | None = None, not_null: str | None = None) -> None:
        """A new rule, which the rows that are there must keep."""
        t = self.tables[name]
        before = (t.primary_key, list(t.unique), set(t.not_null), list(t.checks), list(t.foreign_keys))
        t.primary_key = primary_key or t.primary_key
        t.unique += [unique] if unique else []
        t.checks += [check] if check else []
        t.foreign_keys += [foreign_key] if foreign_key else []
        t.not_null |= {not_null} if not_null else set()
        try:
            self.check(name, self.read(name))
        except ConstraintError:
            t.primary_key, t.unique, t.not_null, t.checks, t.foreign_keys = before
            raise
        self.save()

    def create_view(self, name: str, sql: str) -> None:
        self.views[name] = sql
        self.save()

    def drop_view(self, name: str, if_exists: bool = False) -> None:
        if self.views.pop(name, None) is None and not if_exists:
            raise KeyError(name)
        self.save()

    def create_sequence(self, name: str, start: int = 1) -> None:
        self.sequences[name] = start - 1
        self.save()

    def nextval(self, name: str) -> int:
        self.sequences[name] += 1
        self.save()
        return self.sequences[name]

    def create_index(self, name: str, table: str, kind: str = "scalar", columns: tuple[str, ...] = (), **options) -> None:  # noqa: ANN003
        """Metadata: layouts and statistics of Parquet take the place of index structures."""
        if kind not in ("scalar", "fulltext", "vector", "hybrid", "column", "time_series"):
            raise ValueError(f"unknown kind of index: {kind}")
        self.indexes[name] = {"table": table, "kind": kind, "columns": list(columns), **options}
        self.save()

    # --- reads

    def read(self, name: str) -> DataFrame:
        for layer in reversed(self.staged):
            if name in layer:
                return layer[name]
        if name in self.views:
            return self.sql(self.views[name])
        if name not in self.tables:
            name = next((n for n in (f"projection_{name}", f"rollup_{name}") if self.store.exists(n)), name)
        if not self.staged or name not in self.seen:
            self.seen[name] = self.store.generation(name)
        return self.store.read(name)

    # --- writes

    def _publish(self, changes: dict[str, DataFrame]) -> None:
        changes = {n: settle(df) for n, df in changes.items()}
        for n, df in changes.items():
            self.check(n, df, changes)
        if self.staged:
            self.staged[-1].update(changes)
            return
        self._commit(changes)

    def _commit(self, changes: dict[str, DataFrame]) -> None:
        """All changes in one step; tables that another writer changed since they were read are a conflict."""
        versions = {n: (self.store.stage(n, df), df.schema.json()) for n, df in changes.items()}
        self.store.activate_all(versions, {n: g for n, g in self.seen.items() if n in versions})
        self.seen = {}
        for n in versions:
            for f in self.listeners:
                f(n)

    def check(self, name: str, df: DataFrame, changes: dict[str, DataFrame] | None = None) -> None:
        """Raises where a version breaks a constraint; each kind is one query."""
        t = self.tables[name]
        required = sorted(t.not_null | set(t.primary_key))
        broken = [F.col(c).isNull() for c in required] + [~F.coalesce(F.expr(c), F.lit(True)) for c in t.checks]
        if broken:
            flags = df.agg(*(F.max(b.cast("int")).alias(f"b{i}") for i, b in enumerate(broken))).first()
            for what, flag in zip([*(f"{c} is null" for c in required), *t.checks], flags):
                if flag:
                    raise ConstraintError(f"{name}: {what}")
        for keys in [*([t.primary_key] if t.primary_key else []), *t.unique]:
            full = df.filter(" and ".join(f"{k} is not null" for k in keys))
            if full.groupBy(*keys).count().filter("count > 1").take(1):
                raise ConstraintError(f"{name}: {', '.join(keys)} not unique")
        for fk in t.foreign_keys:
            target = (changes or {}).get(fk.table)
            target = target if target is not None else self.read(fk.table)
            if df.filter(F.col(fk.column).isNotNull()).join(target, df[fk.column] == target[fk.target], "left_anti").take(1):
                raise ConstraintError(f"{name}: {fk.column} has no {fk.table}")

    def _rows(self, name: str, rows: DataFrame) -> DataFrame:
        t = self.tables[name]
        return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.expr(t.defaults.get(f.name, "null")).cast(f.dataType).alias(f.name) for f in t.schema))

    def insert(self, name: str, rows: DataFrame, conflict: tuple[str, ...] = (), update: dict[str, str] | None = None, where: str = "true") -> DataFrame:
        """INSERT; with ``conflict`` keys DO NOTHING, or DO UPDATE by expressions over ``old`` and ``excluded`` where a condition holds."""
        if name not in self.tables:
            raise ValueError(f"{name} is no table that can be written")
        new, old = self._rows(name, rows), self.read(name)
        if not conflict:
            self._publish({name: old.union(new)})
            return new
        new = settle(new)
        if update and new.groupBy(*conflict).count().filter("count > 1").take(1):
            raise ConstraintError("a row would be updated twice")
        first = new.withColumn("__n", F.row_number().over(Window.partitionBy(*conflict).orderBy(*(F.col(c).asc_nulls_last() for c in new.columns)))).filter("__n = 1").drop("__n")
        fresh = first.join(old.select(*conflict), list(conflict), "left_anti").select(*old.columns)
        if update:
            o, x = old.alias("old"), new.alias("excluded")
            on = [F.col(f"old.{k}") == F.col(f"excluded.{k}") for k in conflict]
            met = F.col(f"excluded.{conflict[0]}").isNotNull() & F.coalesce(F.expr(where), F.lit(False))
            both = o.join(x, on, "left")
            touched = settle(both.filter(met).select(*(F.expr(update[c]).cast(o.schema[c].dataType).alias(c) if c in update else F.col(f"old.{c}").alias(c) for c in o.columns)))
            old = both.select(*(F.when(met, F.expr(update[c])).otherwise(F.col(f"old.{c}")).cast(o.schema[c].dataType).alias(c) if c in update else F.col(f"old.{c}").alias(c) for c in o.columns))
            fresh_rows = settle(fresh)
            self._publish({name: old.union(fresh_rows)})
            return fresh_rows.unionByName(touched)
        self._publish({name: old.union(fresh)})
        return fresh

    def update(self, name: str, assignments: dict[str, str], where: str = "true") -> DataFrame:
        """UPDATE with the actions of foreign keys on changed targets; returns the rows as they are afterwards."""
        old = self.read(name)
        hit = F.coalesce(F.expr(where), F.lit(False))
        value = lambda c: F.expr(assignments[c]).cast(old.schema[c].dataType) if c in assignments else F.col(c)
        out = settle(old.select(*(F.when(hit, value(c)).otherwise(F.col(c)).alias(c) if c in assignments else F.col(c) for c in old.columns), hit.alias("__hit"), *(F.col(c).alias(f"__was_{c}") for c in assignments)))
        changes = {name: out.select(*old.columns)}
        for child in self.tables.values():
            for fk in (f for f in child.foreign_keys if f.table == name and f.target in assignments and f.on_update != "no action"):
                rows = self.read(child.name)
                moved = out.filter(F.col("__hit") & ~F.col(fk.target).eqNullSafe(F.col(f"__was_{fk.target}"))).select(F.col(f"__was_{fk.target}").alias("__from"), F.col(fk.target).alias("__to"))
                both = rows.join(moved, rows[fk.column] == F.col("__from"), "left")
                if fk.on_update == "restrict" and both.filter("__from is not null").take(1):
                    raise ConstraintError(f"{child.name}.{fk.column} refers to rows of {name}")
                new = {"cascade": F.col("__to"), "set null": F.lit(None), "set default": F.expr(child.defaults.get(fk.column, "null"))}.get(fk.on_update, F.col(fk.column))
                changes[child.name] = both.select(*(F.when(F.col("__from").isNotNull(), new).otherwise(F.col(c)).cast(rows.schema[c].dataType).alias(c) if c == fk.column else F.col(c) for c in rows.columns))
        self._publish(changes)
        return out.filter("__hit").select(*old.columns)

    def delete(self, name: str, where: str = "true") -> DataFrame:
        """DELETE with the actions of foreign keys; rows whose condition is unknown stay."""
        old = self.read(name)
        gone = settle(old.filter(F.coalesce(F.expr(where), F.lit(False))))
        changes = {name: old.filter(~F.coalesce(F.expr(where), F.lit(False)))}
        self._referential(name, gone, changes)
        self._publish(changes)
        return gone

    def _referential(self, name: str, gone: DataFrame, changes: dict[str, DataFrame]) -> None:
        for child in self.tables.values():
            for fk in (f for f in child.foreign_keys if f.table == name):
                rows = changes.get(child.name)
                rows = rows if rows is not None else self.read(child.name)
                lost = gone.select(F.col(fk.target).alias("__k")).distinct()
                hit = settle(rows.join(lost, rows[fk.column] == F.col("__k"), "left_semi"))
                if not hit.take(1):
                    continue
                rest = rows.join(lost, rows[fk.column] == F.col("__k"), "left_anti")
                if fk.on_delete in ("no action", "restrict"):
                    raise ConstraintError(f"{child.name}.{fk.column} refers to rows of {name}")
                if fk.on_delete == "cascade":
                    changes[child.name] = rest
                    self._referential(child.name, hit, changes)
                else:
                    value = F.lit(None) if fk.on_delete == "set null" else F.expr(child.defaults.get(fk.column, "null"))
                    changes[child.name] = rest.union(hit.withColumn(fk.column, value.cast(hit.schema[fk.column].dataType)))

    # --- transactions

    def begin(self) -> None:
        if self.staged:
            raise ValueError("a transaction is open")
        self.staged = [{}]

    def savepoint(self, name: str) -> None:
        self.savepoints.append((name, len(self.staged)))
        self.staged.append({})

    def _mark(self, name: str) -> int:
        for i in range(len(self.savepoints) - 1, -1, -1):
            if self.savepoints[i][0] == name:
                return i
        raise KeyError(name)

    def rollback_to(self, name: str) -> None:
        i = self._mark(name)
        self.staged = [*self.staged[: self.savepoints[i][1]], {}]
        self.savepoints = self.savepoints[: i + 1]

    def release(self, name: str) -> None:
        i = self._mark(name)
        at = self.savepoints[i][1]
        merged: dict[str, DataFrame] = {}
        for layer in self.staged[at:]:
            merged |= layer
        self.staged = self.staged[:at]
        self.staged[-1].update(merged)
        self.savepoints = self.savepoints[:i]

    def rollback(self) -> None:
        self.staged, self.savepoints, self.seen = [], [], {}

    def commit(self) -> None:
        merged: dict[str, DataFrame] = {}
        for layer in self.staged:
            merged |= layer
        self.staged, self.savepoints = [], []
        self._commit(merged)

    # --- functions and procedures

    def create_function(self, name: str, params: str, returns: str, body: str, keep: bool = True) -> None:
        """A SQL expression function: Catalyst inlines it."""
        from quillmark.plans.dialect import names_in

        if name.lower() in {w.lower() for w in names_in(body)}:
            raise ValueError(f"{name} refers to itself")
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {returns} RETURN {body}")
        self.functions[name] = [params, returns, body]
        if keep:
            self.save()

    def drop_function(self, name: str, if_exists: bool = False) -> None:
        self.spark.sql(f"DROP TEMPORARY FUNCTION {'IF EXISTS ' if if_exists else ''}{name}")
        self.functions.pop(name, None)
        self.save()

    def create_procedure(self, name: str, statement: str) -> None:
        if ";" in statement.strip().rstrip(";"):
            raise ValueError("a procedure holds one statement")
        self.procedures[name] = statement
        self.save()

    def call(self, name: str, *args: object) -> DataFrame | None:
        return self.execute(self.procedures[name], list(args))

    # --- virtual catalog

    def information_schema(self, view: str) -> DataFrame:
        t = self.tables
        rows = {
            "tables": ("table_name string, table_type string", [(n, "BASE TABLE") for n in t] + [(n, "VIEW") for n in self.views]),
            "columns": ("table_name string, column_name string, ordinal_position int, data_type string, is_nullable string, column_default string", [(n, f.name, i + 1, f.dataType.simpleString(), "NO" if f.name in x.not_null | set(x.primary_key) else "YES", x.defaults.get(f.name)) for n, x in t.items() for i, f in enumerate(x.schema)]),
            "views": ("table_name string, view_definition string", list(self.views.items())),
            "schemata": ("schema_name string", [(x,) for x in [*self.schemas, "information_schema"]]),
            "sequences": ("sequence_name string, last_value long", list(self.sequences.items())),
            "table_constraints": ("table_name string, constraint_type string, definition string", [(n, k, d) for n, x in t.items() for k, d in [*([("PRIMARY KEY", ", ".join(x.primary_key))] if x.primary_key else []), *(("UNIQUE", ", ".join(u)) for u in x.unique), *(("CHECK", c) for c in x.checks), *(("FOREIGN KEY", f"{f.column} -> {f.table}.{f.target}") for f in x.foreign_keys)]]),
            "key_column_usage": ("table_name string, column_name string, ordinal_position int", [(n, c, i + 1) for n, x in t.items() for i, c in enumerate(x.primary_key)]),
            "referential_constraints": ("table_name string, column_name string, target_table string, target_column string, delete_rule string", [(n, f.column, f.table, f.target, f.on_delete.upper()) for n, x in t.items() for f in x.foreign_keys]),
            "indexes": ("index_name string, table_name string, kind string", [(n, i["table"], i["kind"]) for n, i in self.indexes.items()]),
            "settings": ("name string, setting string", list(self.settings.items())),
        }
        ddl, data = rows[view]
        return self.spark.createDataFrame(data, ddl)


def renamed(items: list, column: str, to: str) -> list:
    """A tree of tokens with one column under another name."""
    return [Group(renamed(x.items, column, to)) if isinstance(x, Group) else Token("name", to) if x.kind == "name" and x.text == column else x for x in items]


def key_filter(df: DataFrame, key: str, value: object) -> DataFrame:
    """A point look-up: the filter reaches the scan, where row-group statistics prune."""
    c: Column = F.col(key) == F.lit(value)
    return df.filter(c)
