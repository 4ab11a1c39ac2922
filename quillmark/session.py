"""The engine: one session with the dialect's settings, tables and SQL."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import search
from quillmark.functions.session import Session
from quillmark.operators import graph
from quillmark.operators.recursive import fixpoint
from quillmark.plans.dialect import Context, DialectError, names_in, rewrite
from quillmark.plans.tree import quote

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.cteRecursionLevelLimit": "64",
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def configure(spark: SparkSession) -> None:
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)


class SqlContext(Context):
    """Looks tables, graphs and session values up for one statement; views it makes have names of their own."""

    def __init__(self, owner: Queries, args: list | None) -> None:
        self.owner, self.args, self.spark = owner, args, owner.spark

    def analyzer(self, table: str | None, field: str) -> tuple[search.Analyzer, dict]:
        return self.owner.search_options(table, field.split(".")[-1].strip("`"))

    def score(self, table: str | None, field: str, query: str) -> str:
        if table is None:
            return search.fraction_sql(field, query)
        analyzer, options = self.analyzer(table, field)
        name = field.split(".")[-1].strip("`")
        words = analyzer.query(query)
        c = search.corpus(self.owner.table(table), name, words, analyzer)
        return search.score_sql(field, words, c, analyzer, **options)

    def match(self, field: str, query: str) -> str:
        return search.match_sql(field, query)

    def snippet(self, field: str, query: str) -> str:
        return search.snippet_sql(field, query)

    def graph(self, name: str, args: list, starts: str | None = None) -> str:
        edges = self.owner.edges(str(args[0]))
        if starts is not None:
            nodes = self.owner.sql(starts).select(F.col("node_id").alias("start"), F.lit(args[1]).alias("node_type"), "node_id")
            found = graph.expand_all(edges, nodes, *(a for a in args[3:]))
        else:
            call = {"graph_neighbors": graph.neighbors, "graph_expand": graph.expand, "graph_shortest_path": graph.shortest_path}[name]
            found = call(edges, *args[1:])
        return self.view(found)

    def view(self, df: DataFrame) -> str:
        name = f"__view_{uuid.uuid4().hex}"
        df.createOrReplaceTempView(name)
        return name

    def recursive(self, name: str, columns: list[str], anchor: str, step: str) -> str:
        first = self.owner.run(anchor, {}, self.args)
        first = first.toDF(*(c.strip("`") for c in columns)) if columns else first

        def grow(frontier: DataFrame) -> DataFrame:
            frontier.createOrReplaceTempView(name)
            new = self.owner.run(step, {}, self.args)
            if len(new.columns) != len(first.columns):
                raise DialectError(f"{name}: anchor and step differ in width")
            return new.select(*(F.col(f"`{c}`").cast(t).alias(k) for c, (k, t) in zip(new.columns, first.dtypes)))

        fixpoint(first, grow).createOrReplaceTempView(name)
        return name

    def session(self, name: str, args: list[str | None]) -> str | None:
        s = self.owner.session
        if name == "version" and not args:
            return quote(s.version_text())
        if name in ("current_schema", "current_database", "current_user", "session_user", "current_role") and not args:
            return quote({"current_schema": s.schema, "current_database": s.database}.get(name, s.user))
        if name == "current_setting":
            value = s.setting(args[0], len(args) > 1 and str(args[1]).lower() == "true")
            return "cast(NULL AS string)" if value is None else quote(value)
        if name == "set_config":
            s.change(args[0], args[1], len(args) > 2 and str(args[2]).lower() == "true")
            return quote(args[1])
        if name in ("has_database_privilege", "has_schema_privilege", "has_table_privilege", "pg_table_is_visible"):
            return "true"
        if name == "pg_get_userbyid":
            return quote(s.user)
        if name in ("obj_description", "col_description"):
            return "cast(NULL AS string)"
        if name == "pg_get_expr":
            return f"cast({args[0] if not args[0].isidentifier() else args[0]} AS string)"
        if name == "pg_backend_pid":
            return str(s.pid)
        if name == "pg_encoding_to_char":
            return f"CASE {args[0]} WHEN 6 THEN 'UTF8' WHEN 0 THEN 'SQL_ASCII' ELSE '' END"
        return None


class Queries:
    """What an engine over files and a database share: SQL of the dialect over named tables."""

    spark: SparkSession
    session: Session

    def table(self, name: str) -> DataFrame:
        raise NotImplementedError

    def table_names(self) -> set[str]:
        raise NotImplementedError

    def edges(self, graph_name: str) -> DataFrame:
        """The edges of a graph; without one of that name, of the table that has it."""
        return self.table(graph_name)

    def search_options(self, table: str | None, field: str) -> tuple[search.Analyzer, dict]:
        """The analyzer and BM25 options of a field's full-text index."""
        return search.Analyzer(), {}

    def run(self, text: str, named: dict, args: list | None = None) -> DataFrame:
        """Runs Spark SQL over the tables that it names."""
        for name in names_in(text) & self.table_names():
            self.table(name).createOrReplaceTempView(name)
        if not named and args:
            named = {f"p{k + 1}": v for k, v in enumerate(args) if f":p{k + 1}" in text}
        return self.spark.sql(text, args=named) if named else self.spark.sql(text)

    def sql(self, text: str, args: list | None = None) -> DataFrame:
        """Translates a query and runs it over the tables that it names."""
        if "pg_show_all_settings" in text:
            rows = [(k, v) for k, v in sorted(self.session.settings.items())]
            self.spark.createDataFrame(rows, "name string, setting string").createOrReplaceTempView("__settings")
            text = text.replace("pg_show_all_settings()", "__settings")
        translated, named = rewrite(text, SqlContext(self, args), args)
        return self.run(translated, named)

    def explain(self, text: str, analyze: bool = False, args: list | None = None) -> str:
        """The formatted physical plan of a query; with ``analyze``, of a run, with its rows and seconds."""
        df = self.sql(text, args)
        mode = self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        if not analyze:
            return df._jdf.queryExecution().explainString(mode)
        began = time.perf_counter()
        counted = df.groupBy().count()
        rows = counted.first()[0]
        return f"{counted._jdf.queryExecution().explainString(mode)}\nrows: {rows}\nseconds: {time.perf_counter() - began:.3f}"


class Engine(Queries):
    """SQL of the dialect over the Parquet tables of a folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.session = spark, folder.rstrip("/"), Session()
        self.graphs: dict[str, DataFrame] = {}
        configure(spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def table_names(self) -> set[str]:
        return set(TABLES)

    def create_graph(self, name: str, edges: DataFrame) -> None:
        self.graphs[name] = edges

    def edges(self, graph_name: str) -> DataFrame:
        return self.graphs[graph_name] if graph_name in self.graphs else self.table(graph_name)
