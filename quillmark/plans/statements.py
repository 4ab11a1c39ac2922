"""Statements of the dialect other than queries, read from tokens and run on a database."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.plans.dialect import _TYPES, DialectError, Rewriter
from quillmark.plans.tree import Group, Node, Token, find, is_op, parse, render, split, sql, string_of, words

#: What may not stand inside a transaction.
OUTSIDE = ("copy", "create", "drop", "alter", "refresh", "enforce", "verify", "repair")


class Statements:
    def __init__(self, database) -> None:  # noqa: ANN001
        self.db, self.spark = database, database.spark

    def run(self, text: str, args: list | None = None) -> DataFrame | None:
        items = parse(text.strip().rstrip(";"))
        if not items:
            return None
        self.args, self.text = args, text.strip().rstrip(";")
        head = items[0].word()
        if head in OUTSIDE and self.db.staged:
            raise DialectError(f"{head.upper()} may not stand inside a transaction")
        call: Callable | None = getattr(self, f"do_{head}", None)
        return call(items) if call else self.db.sql(text, args)

    # --- helpers

    def expr(self, items: list[Node], columns: dict[str, str] | None = None, table: str = "") -> str:
        """An expression with its parameters as literals, as DML runs it on columns; ``columns`` says what stands for a bare name."""
        r = Rewriter(None, None)
        r.param = lambda n: literal(self.args[n - 1]) if self.args and n <= len(self.args) else "NULL"  # type: ignore[method-assign]
        return render(r.expr(qualified(items, columns, table) if columns is not None else items))

    def writable(self, x: Node) -> str:
        """The name of a table; views and outputs of projections cannot be written."""
        if ident(x) not in self.db.tables:
            raise DialectError(f"{ident(x)} is no table that can be written")
        return ident(x)

    def rows(self, items: list[Node]) -> DataFrame:
        """A query or VALUES as rows."""
        if items[0].word() != "values":
            return self.db.sql(render(items), self.args)
        parts = [f"({', '.join(self.expr(v) for v in split(g.items))})" for g in split_groups(items[1:])]
        return self.spark.sql(f"SELECT * FROM VALUES {', '.join(parts)}")

    def returning(self, df: DataFrame, items: list[Node] | None) -> DataFrame | None:
        if items is None:
            return None
        return df.selectExpr(*(self.expr(x) for x in split(items)))

    def message(self, **values: object) -> DataFrame:
        row = {k: str(v) if not isinstance(v, (int, bool, str, type(None))) else v for k, v in values.items()}
        ddl = ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'long' if isinstance(v, int) else 'string'}" for k, v in row.items())
        return self.spark.createDataFrame([tuple(row.values())], ddl)

    # --- DML

    def do_insert(self, items: list[Node]) -> DataFrame | None:
        name = self.writable(items[2])
        i = 3
        columns = None
        if isinstance(items[i], Group) and (not items[i].items or items[i].items[0].word() not in ("select", "with")):
            columns, i = [ident(c[0]) for c in split(items[i].items)], i + 1
        end = next((k for k in (find(items, "on", "conflict"), find(items, "returning")) if k >= 0), len(items))
        body = items[i:end]
        if body[0].word() == "default":
            rows = self.spark.range(1).select()
        else:
            rows = self.rows(body.pop().items if isinstance(body[0], Group) else body)
            target = columns or [f.name for f in self.db.tables[name].schema]
            if len(rows.columns) > len(target):
                raise DialectError("more values than columns")
            rows = rows.toDF(*target[: len(rows.columns)])
        ret = find(items, "returning")
        returned = items[ret + 1 :] if ret >= 0 else None
        at = find(items, "on", "conflict")
        if at < 0:
            return self.returning(self.db.insert(name, rows), returned)
        keys = tuple(ident(c[0]) for c in split(items[at + 2].items))
        if not any(set(keys) == set(u) for u in (self.db.tables[name].primary_key, *self.db.tables[name].unique)):
            raise DialectError("ON CONFLICT needs the columns of a primary key or unique constraint")
        rest = items[at + 4 : ret if ret >= 0 else len(items)]
        if rest[0].word() == "nothing":
            return self.returning(self.db.insert(name, rows, keys), returned)
        where = find(rest, "where")
        old = {f.name: f"old.`{f.name}`" for f in self.db.tables[name].schema}
        sets = self.assignments(rest[2 : where if where >= 0 else len(rest)], old, name)
        return self.returning(self.db.insert(name, rows, keys, sets, self.expr(rest[where + 1 :], old, name) if where >= 0 else "true"), returned)

    def assignments(self, items: list[Node], columns: dict[str, str] | None = None, table: str = "") -> dict[str, str]:
        return {ident(part[0]): self.expr(part[2:], columns, table) for part in split(items)}

    def do_update(self, items: list[Node]) -> DataFrame | None:
        name, ret, where = self.writable(items[1]), find(items, "returning"), find(items, "where")
        end = ret if ret >= 0 else len(items)
        own = {f.name: f"`{f.name}`" for f in self.db.tables[name].schema}
        sets = self.assignments(items[3 : where if where >= 0 else end], own, name)
        out = self.db.update(name, sets, self.expr(items[where + 1 : end], own, name) if where >= 0 else "true")
        return self.returning(out, items[ret + 1 :] if ret >= 0 else None)

    def do_delete(self, items: list[Node]) -> DataFrame | None:
        name, ret, where = self.writable(items[2]), find(items, "returning"), find(items, "where")
        end = ret if ret >= 0 else len(items)
        own = {f.name: f"`{f.name}`" for f in self.db.tables[name].schema}
        gone = self.db.delete(name, self.expr(items[where + 1 : end], own, name) if where >= 0 else "true")
        return self.returning(gone, items[ret + 1 :] if ret >= 0 else None)

    def do_copy(self, items: list[Node]) -> None:
        """COPY t FROM 'path' [WITH (HEADER false)]."""
        from quillmark.sources.tables import copy_csv

        name = self.writable(items[1])
        columns = [ident(c[0]) for c in split(items[2].items)] if isinstance(items[2], Group) else None
        path = string_of(items[find(items, "from") + 1])
        options = next((g.items for g in reversed(items) if isinstance(g, Group) and columns is None or isinstance(g, Group) and g is not items[2]), [])
        header = not any(len(o) > 1 and o[0].word() == "header" and o[1].word() in ("false", "off") for o in split(options))
        schema = self.db.tables[name].schema
        chosen = [schema[c] for c in columns] if columns else schema.fields
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen)
        self.db.insert(name, copy_csv(self.spark, path, ddl, header))

    # --- transactions

    def do_begin(self, items: list[Node]) -> None:
        self.db.begin()

    do_start = do_begin

    def do_commit(self, items: list[Node]) -> None:
        self.db.commit()

    def do_rollback(self, items: list[Node]) -> None:
        at = find(items, "to")
        self.db.rollback() if at < 0 else self.db.rollback_to(ident(items[-1]))

    def do_savepoint(self, items: list[Node]) -> None:
        self.db.savepoint(ident(items[1]))

    def do_release(self, items: list[Node]) -> None:
        self.db.release(ident(items[-1]))

    # --- definitions

    def do_create(self, items: list[Node]) -> DataFrame | None:
        items, _ = without(items, "or", "replace")
        what = items[1].word()
        if what in ("unique", "materialized", "retention"):
            call = {"unique": self.index, "materialized": self.projection, "retention": self.policy}[what]
            return call(items)
        call = getattr(self, f"create_{what}", None)
        if call is None:
            raise DialectError(f"CREATE {what.upper()} is not known")
        return call(items)

    def create_table(self, items: list[Node]) -> None:
        items, lenient = without(items, "if", "not", "exists")
        from quillmark.sources.catalog import ForeignKey

        name, ddl = ident(items[2]), []
        key: tuple[str, ...] = ()
        unique, not_null, checks, defaults, foreign = [], set(), [], {}, []
        for part in split(items[3].items):
            head = part[0].word()
            if head == "constraint":
                part, head = part[2:], part[2].word()
            if head in ("primary", "unique", "check", "foreign"):
                group = next(x for x in part if isinstance(x, Group))
                cols = tuple(ident(c[0]) for c in split(group.items)) if head != "check" else ()
                if head == "primary":
                    key = cols
                elif head == "unique":
                    unique.append(cols)
                elif head == "check":
                    checks.append(self.expr(group.items))
                else:
                    foreign.append(self.foreign(cols[0], part[find(part, "references") :], ForeignKey))
                continue
            column = ident(part[0])
            kind, i = self.kind(part, 1)
            ddl.append(f"`{column}` {kind}")
            while i < len(part):
                w = part[i].word()
                if w == "primary":
                    key, i = (column,), i + 2
                elif w == "unique":
                    unique.append((column,))
                    i += 1
                elif w == "not":
                    not_null.add(column)
                    i += 2
                elif w == "default":
                    end = next((k for k in range(i + 2, len(part)) if part[k].word() in ("primary", "unique", "not", "check", "references", "constraint")), len(part))
                    defaults[column] = self.expr(part[i + 1 : end])
                    i = end
                elif w == "check":
                    checks.append(self.expr(part[i + 1].items))
                    i += 2
                elif w == "references":
                    foreign.append(self.foreign(column, part[i:], ForeignKey))
                    i = len(part)
                else:
                    i += 1
        self.db.create_table(name, ", ".join(ddl), lenient, primary_key=key, unique=unique, not_null=not_null, checks=checks, defaults=defaults, foreign_keys=foreign)

    def kind(self, part: list[Node], i: int) -> tuple[str, int]:
        """A column's type as Spark has it, and the place after it."""
        w = part[i].word()
        sized = i + 1 < len(part) and isinstance(part[i + 1], Group)
        if w == "double" and i + 1 < len(part) and part[i + 1].word() == "precision":
            return "double", i + 2
        return ("array<double>" if w == "vector" else _TYPES.get(w, w)), i + 1 + sized

    def foreign(self, column: str, items: list[Node], make: type) -> object:
        target = ident(split(items[2].items)[0][0]) if len(items) > 2 and isinstance(items[2], Group) else None
        table = ident(items[1])
        rules = {}
        for verb in ("delete", "update"):
            at = find(items, "on", verb)
            if at >= 0:
                w = [x.word() for x in items[at + 2 : at + 4]]
                rules[f"on_{verb}"] = " ".join(w) if w[0] in ("set", "no") else w[0]
        return make(column, table, target or self.db.tables[table].primary_key[0], **rules)

    def create_view(self, items: list[Node]) -> None:
        self.db.create_view(ident(items[2]), render(items[find(items, "as") + 1 :]))

    def create_sequence(self, items: list[Node]) -> None:
        items, lenient = without(items, "if", "not", "exists")
        if lenient and ident(items[2]) in self.db.sequences:
            return
        start = next((int(x.text) for x in items[3:] if isinstance(x, Token) and x.kind == "number"), 1)
        self.db.create_sequence(ident(items[2]), start)

    def create_schema(self, items: list[Node]) -> None:
        items, lenient = without(items, "if", "not", "exists")
        if ident(items[2]) in self.db.schemas:
            if lenient:
                return
            raise DialectError(f"{ident(items[2])} exists")
        self.db.schemas.append(ident(items[2]))
        self.db.save()

    create_database = create_schema

    def create_index(self, items: list[Node]) -> None:
        self.index(items)

    def index(self, items: list[Node]) -> None:
        items, lenient = without(items, "if", "not", "exists")
        unique = items[1].word() == "unique"
        on, using = find(items, "on"), find(items, "using")
        name, table = ident(items[on - 1]), ident(items[on + 1])
        if name in self.db.indexes:
            if lenient:
                return
            raise DialectError(f"index {name} exists")
        kind = items[using + 1].word() if using >= 0 else "btree"
        kind = {"btree": "scalar", "hash": "scalar", "hnsw": "vector", "ivfflat": "vector", "bruteforce": "vector"}.get(kind, kind)
        group = next(x for x in items[on + 2 :] if isinstance(x, Group))
        columns = tuple(self.expr(c) for c in split(group.items))
        at, where = find(items, "with"), find(items, "where")
        options = {render([o[0]]): value_of(o[-1]) for o in split(items[at + 1].items)} if at >= 0 else {}
        if unique:
            self.db.add_constraint(table, unique=columns)
        more = {"where": self.expr(items[where + 1 :])} if where >= 0 else {}
        self.db.create_index(name, table, kind, columns, options=options, unique=unique, **more)

    def create_function(self, items: list[Node]) -> None:
        """CREATE FUNCTION f(a T, ...) RETURNS T [IMMUTABLE] AS 'expression'."""
        name, at, body = ident(items[2]), find(items, "returns"), find(items, "as")
        params = ", ".join(f"{ident(p[0])} {self.kind(p, 1)[0]}" for p in split(items[3].items))
        self.db.create_function(name, params, self.kind(items, at + 1)[0], self.expr(parse(string_of(items[body + 1]))))

    def create_procedure(self, items: list[Node]) -> None:
        """CREATE PROCEDURE p(a T, ...) AS 'one statement'; names of parameters or $n stand for the arguments."""
        names = [ident(p[0]) for p in split(items[3].items)]
        body = string_of(items[find(items, "as") + 1])
        first = parse(body)[0].word()
        if first in ("begin", "commit", "rollback", "call", "create", "do"):
            raise DialectError("a procedure is one query or DML statement")
        self.db.create_procedure(ident(items[2]), render(named(parse(body), names)))

    def do_call(self, items: list[Node]) -> DataFrame | None:
        values = [Rewriter(None, self.args).value(a) for a in split(items[2].items)] if len(items) > 2 else []
        return self.db.call(ident(items[1]), *values)

    def create_graph(self, items: list[Node]) -> None:
        """CREATE GRAPH g (NODES (...), EDGES (...)): the tables g_nodes and g_edges, with the columns that graphs have."""
        name = ident(items[2])
        extra = {part[0].word(): part[1].items for part in split(items[3].items)}
        more = lambda k: "".join(f", `{ident(c[0])}` {self.kind(c, 1)[0]}" for c in split(extra.get(k, [])))
        self.db.graphs[name] = {"nodes": f"{name}_nodes", "edges": f"{name}_edges"}
        self.db.create_table(f"{name}_nodes", "node_type string, node_id string" + more("nodes"), primary_key=("node_type", "node_id"))
        self.db.create_table(f"{name}_edges", "edge_id string, source_type string, source_id string, target_type string, target_id string, edge_type string, weight double" + more("edges"), primary_key=("edge_id",), checks=["weight >= 0"])

    def do_drop(self, items: list[Node]) -> None:
        items, lenient = without(items, "if", "exists")
        what, name = items[1].word(), ident(items[-1])
        if what == "table":
            return self.db.drop_table(name, lenient)
        if what == "view":
            return self.db.drop_view(name, lenient)
        if what == "function":
            name = ident(items[2])
            return None if lenient and name not in self.db.functions else self.db.drop_function(name, lenient)
        if what == "materialized":
            return self.projections().drop(name)
        if what == "rollup":
            return self.rollups().drop(name, lenient)
        if what == "graph":
            self.db.graphs.pop(name)
            self.db.drop_table(f"{name}_nodes")
            return self.db.drop_table(f"{name}_edges")
        held = {"index": self.db.indexes, "sequence": self.db.sequences, "procedure": self.db.procedures, "retention": self.db.policies}.get(what)
        if what in ("schema", "database"):
            if name in self.db.schemas:
                self.db.schemas.remove(name)
            elif not lenient:
                raise KeyError(name)
        elif held is None:
            raise DialectError(f"DROP {what.upper()} is not known")
        elif held.pop(name, None) is None and not lenient:
            raise KeyError(name)
        return self.db.save()

    def do_alter(self, items: list[Node]) -> None:
        from quillmark.sources.catalog import ForeignKey

        if items[1].word() == "retention":
            self.db.policies[ident(items[3])]["retain_for"] = string_of(items[-1])
            return self.db.save()
        if items[1].word() == "schema":
            k = self.db.schemas.index(ident(items[2]))
            self.db.schemas[k] = ident(items[-1])
            return self.db.save()
        name, verb = ident(items[2]), [x.word() for x in items[3:5]]
        t = self.db.tables[name]
        if verb[0] == "add":
            at = 5 if verb[1] in ("column",) else 4
            if verb[1] in ("constraint", "primary", "unique", "check", "foreign"):
                part = items[6:] if verb[1] == "constraint" else items[4:]
                group = next(x for x in part if isinstance(x, Group))
                head = part[0].word()
                cols = tuple(ident(c[0]) for c in split(group.items)) if head != "check" else ()
                if head == "foreign":
                    return self.db.add_constraint(name, foreign_key=self.foreign(cols[0], part[find(part, "references") :], ForeignKey))
                return self.db.add_constraint(name, **({"check": self.expr(group.items)} if head == "check" else {"primary_key" if head == "primary" else "unique": cols}))
            kind, i = self.kind(items, at + 1)
            default = find(items, "default")
            self.db.alter_add(name, ident(items[at]), kind, self.expr(items[default + 1 :]) if default >= 0 else None)
            return self.db.add_constraint(name, not_null=ident(items[at])) if find(items, "not", "null", start=i) >= 0 else None
        if verb[0] == "drop":
            if verb[1] == "constraint":
                raise DialectError("constraints have no names here; drop the column or the table")
            return self.db.alter_drop(name, ident(items[-1]))
        if verb[0] == "rename":
            if verb[1] == "to":
                return self.db.rename_table(name, ident(items[-1]))
            return self.db.alter_rename(name, ident(items[-3]), ident(items[-1]))
        if verb[0] == "alter":
            at = 5 if items[4].word() == "column" else 4
            column, what = ident(items[at]), [x.word() for x in items[at + 1 : at + 3]]
            if what == ["set", "default"]:
                t.defaults[column] = self.expr(items[at + 3 :])
            elif what == ["drop", "default"]:
                t.defaults.pop(column, None)
            elif what == ["set", "not"]:
                return self.db.add_constraint(name, not_null=column)
            elif what == ["drop", "not"]:
                t.not_null.discard(column)
            else:
                raise DialectError(f"unknown ALTER COLUMN: {render(items)}")
            return self.db.save()
        raise DialectError(f"unknown ALTER TABLE: {render(items)}")

    # --- settings and plans

    def do_set(self, items: list[Node]) -> None:
        items, _ = without(items, "session")
        at = next(k for k, x in enumerate(items) if is_op(x, "=") or x.word() == "to")
        self.db.session.change(render(items[1:at]), str(value_of(items[at + 1])))

    def do_show(self, items: list[Node]) -> DataFrame:
        name = render(items[1:]).lower()
        if name == "all":
            return self.spark.createDataFrame(sorted(self.db.settings.items()), "name string, setting string")
        return self.spark.createDataFrame([(self.db.session.setting(name),)], f"`{name}` string")

    def do_explain(self, items: list[Node]) -> DataFrame:
        analyze = items[1].word() == "analyze"
        text = self.db.explain(render(items[1 + analyze :]), analyze, self.args)
        return self.spark.createDataFrame([(line,) for line in text.split("\n")], "plan string")

    # --- rollups, retention, projections

    def rollups(self):  # noqa: ANN201
        from quillmark.operators.timeseries import Rollups

        if not hasattr(self.db, "_rollups"):
            self.db._rollups = Rollups(self.db.store)
            self.db.listeners.append(self.db._rollups.after_write)
        return self.db._rollups

    def create_rollup(self, items: list[Node]) -> None:
        """CREATE ROLLUP r ON t USING time_bucket('1 day', ts) GROUP BY k, ... AGGREGATES f(c) AS n, ... [WHERE ...]."""
        from quillmark.operators.timeseries import Rollup

        on, using, by, of, where = (find(items, w) for w in ("on", "using", "group", "aggregates", "where"))
        width, column = split(items[using + 2].items)
        keys = tuple(ident(k[0]) for k in split(items[by + 2 : of]))
        aggregates = []
        for part in split(items[of + 1 : where if where >= 0 else len(items)]):
            inside = render(part[1].items)
            aggregates.append((part[0].word(), inside, ident(part[-1]) if find(part, "as") >= 0 else f"{part[0].word()}_{inside}"))
        self.rollups().create(Rollup(ident(items[2]), ident(items[on + 1]), string_of(width[0]), ident(column[0]), keys, tuple(aggregates), self.expr(items[where + 1 :]) if where >= 0 else None))

    def do_refresh(self, items: list[Node]) -> None:
        if items[1].word() == "rollup":
            return self.rollups().refresh(ident(items[2]))
        return self.projections().refresh(ident(items[-1]))

    def policy(self, items: list[Node]) -> None:
        """CREATE RETENTION POLICY [IF NOT EXISTS] p ON t USING ts RETAIN FOR '7 days'."""
        items, lenient = without(items, "if", "not", "exists")
        name = ident(items[3])
        if name in self.db.policies:
            if lenient:
                return
            raise DialectError(f"retention policy {name} exists")
        self.db.policies[name] = {"table": ident(items[5]), "time": ident(items[find(items, "using") + 1]), "retain_for": string_of(items[-1])}
        self.db.save()

    def do_enforce(self, items: list[Node]) -> DataFrame:
        """ENFORCE RETENTION POLICY p AT ts: rows that a restricting foreign key holds are skipped like those without a time."""
        from quillmark.functions.scalar import micros

        p = self.db.policies[ident(items[3])]
        table, at = p["table"], string_of(items[-1])
        ts = f"try_to_timestamp(cast(`{p['time']}` AS string))"
        old = f"{ts} < timestamp_micros(unix_micros(cast('{at}' AS timestamp)) - {micros(p['retain_for'])})"
        rows = self.db.read(table)
        held = None
        for child in self.db.tables.values():
            for fk in (f for f in child.foreign_keys if f.table == table and f.on_delete in ("no action", "restrict")):
                used = self.db.read(child.name).select(F.col(fk.column).alias("__used")).filter("__used is not null").distinct()
                hit = rows.join(used, rows[fk.target] == F.col("__used"), "left_semi").select(fk.target)
                held = (fk.target, hit) if held is None else (fk.target, held[1].union(hit))
        marked = rows.withColumn("__old", F.coalesce(F.expr(old), F.lit(False))).withColumn("__bad", F.expr(f"{ts} IS NULL"))
        if held is not None:
            keys = held[1].distinct().select(F.col(held[0]).alias("__held"))
            marked = marked.join(keys, F.col(held[0]) == F.col("__held"), "left")
        else:
            marked = marked.withColumn("__held", F.lit(None).cast("string"))
        from quillmark.sources.shared import settle

        marked = settle(marked)
        gone = F.col("__old") & F.col("__held").isNull()
        counts = marked.agg(*(F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(n) for n, c in (("deleted", gone), ("kept", ~F.col("__old") & ~F.col("__bad")), ("skipped", F.col("__bad") | F.col("__old") & F.col("__held").isNotNull()))))
        changes = {table: marked.filter(~gone).select(*rows.columns)}
        self.db._referential(table, marked.filter(gone).select(*rows.columns), changes)
        counts = settle(counts)
        self.db._publish(changes)
        return counts

    def projections(self):  # noqa: ANN201
        from quillmark.operators.projections import Projections

        if not hasattr(self.db, "_projections"):
            self.db._projections = Projections(self.db.store)
        return self.db._projections

    def projection(self, items: list[Node]) -> None:
        """CREATE MATERIALIZED PROJECTION n [WITH (partition_by = 'a', sort_by = 'b')] AS SELECT ..."""
        name, at = ident(items[3]), find(items, "as")
        options = {render([o[0]]): str(value_of(o[-1])) for o in split(items[5].items)} if items[4].word() == "with" else {}
        query = items[at + 1 :]
        sources = sorted(words(query) & (self.db.tables.keys() | self.db.views.keys()))
        layout = {k: [c.strip() for c in options[k].split(",")] for k in ("partition_by", "sort_by") if k in options}
        self.projections().create(name, render(query), sources, self.db.sql, **layout)

    def do_verify(self, items: list[Node]) -> DataFrame:
        mode = items[find(items, "mode") + 1].word() if find(items, "mode") >= 0 else "full"
        at = find(items, "version")
        out = self.projections().verify(ident(items[2]), mode, str(value_of(items[at + 1])) if at >= 0 else None)
        return self.message(**{k: out[k] for k in ("projection", "mode", "ok", "rows")})

    def do_repair(self, items: list[Node]) -> DataFrame:
        scope = items[find(items, "scope") + 1].word() if find(items, "scope") >= 0 else "full_rebuild"
        return self.message(**self.projections().repair(ident(items[2]), scope))

    def do_plan(self, items: list[Node]) -> DataFrame:
        scope = items[find(items, "scope") + 1].word() if find(items, "scope") >= 0 else "full_rebuild"
        return self.message(**self.projections().plan_repair(ident(items[3]), scope))

    def do_diff(self, items: list[Node]) -> DataFrame:
        """DIFF PROJECTION a WITH b [LIMIT n] [AFTER 'cursor']: a page of changes by row id, with the cursor of the next."""
        from quillmark.operators.projections import diff_page

        limit, after = find(items, "limit"), find(items, "after")
        views = self.projections()
        a, b = views.read(ident(items[2])), views.read(ident(items[4]))
        return diff_page(a, b, [a.columns[0]], int(items[limit + 1].text) if limit >= 0 else 1000, string_of(items[after + 1]) if after >= 0 else None)


def ident(x: Node) -> str:
    if isinstance(x, Group) or x.kind not in ("name", "quoted"):
        raise DialectError(f"a name is expected, not {render([x])}")
    return x.text.strip("`")


def value_of(x: Node) -> object:
    return string_of(x) if isinstance(x, Token) and x.kind == "string" else render([x])


def literal(value: object) -> str:
    from quillmark.plans.tree import quote

    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, (list, tuple)):
        return f"array({', '.join(map(literal, value))})"
    return str(value) if isinstance(value, int) else quote(str(value))


def without(items: list[Node], *names: str) -> tuple[list[Node], bool]:
    """The items without a run of words, and whether it was there."""
    at = find(items, *names)
    return (items, False) if at < 0 else ([*items[:at], *items[at + len(names) :]], True)


def split_groups(items: list[Node]) -> list[Group]:
    return [x for x in items if isinstance(x, Group)]


def qualified(items: list[Node], columns: dict[str, str], table: str) -> list[Node]:
    """Bare column names, and those of the table itself, as ``columns`` has them."""
    out: list[Node] = []
    i = 0
    while i < len(items):
        x = items[i]
        if isinstance(x, Group):
            out.append(x if x.items and x.items[0].word() in ("select", "with") else Group(qualified(x.items, columns, table)))
        elif x.kind in ("name", "quoted") and i + 2 < len(items) and is_op(items[i + 1], "."):
            own = x.text.strip("`") == table and items[i + 2].text.strip("`") in columns
            out += [sql(columns[items[i + 2].text.strip("`")])] if own else items[i : i + 3]
            i += 2
        elif x.kind in ("name", "quoted") and x.text.strip("`") in columns and not (i + 1 < len(items) and isinstance(items[i + 1], Group)):
            out.append(sql(columns[x.text.strip("`")]))
        else:
            out.append(x)
        i += 1
    return out


def named(items: list[Node], names: list[str]) -> list[Node]:
    """Parameter names of a procedure as numbers."""
    return [Group(named(x.items, names)) if isinstance(x, Group) else Token("param", f"${names.index(x.text) + 1}") if x.kind == "name" and x.text in names else x for x in items]
