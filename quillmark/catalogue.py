"""The registered queries of the engine's own operators and their SQL for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import scalar, search, vector
from quillmark.functions.session import Session
from quillmark.operators import graph, projections, relational, timeseries, windows
from quillmark.operators.recursive import fixpoint
from quillmark.session import Engine
from quillmark.sources.catalog import Database, ForeignKey
from quillmark.sources.shared import shared_dir
from quillmark.sources.tables import Store, copy_csv
from quillmark.streaming.replay import Replay

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):  # noqa: ANN201
    def take(f):  # noqa: ANN001, ANN202
        QUERIES[name] = lambda spark, folder: f(Engine(spark, folder))
        if oracle:
            ORACLES[name] = oracle
        return f

    return take


def both(name: str, text: str, oracle: str | None = None) -> None:
    """A query that is SQL of the dialect, with the same or another text for DuckDB."""
    QUERIES[name] = lambda spark, folder: Engine(spark, folder).sql(text)
    ORACLES[name] = oracle or text


def _store(spark: SparkSession) -> Store:
    return Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")


# --- scans, projection, predicates, scalar functions

both("slice_segment_revenue", """
    SELECT c_mktsegment, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total
    FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE o_orderstatus = 'O' GROUP BY c_mktsegment HAVING COUNT(*) > 10
    ORDER BY total DESC, c_mktsegment LIMIT 5""")
both("scan_project_filter", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
both("scan_limit", "SELECT r_regionkey, r_name FROM region ORDER BY r_regionkey LIMIT 3")
both("point_lookup", "SELECT * FROM customer WHERE c_custkey = 42")
both("index_range_read", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 400")
both("single_row", "SELECT 1 AS one, 'x' AS letter")
both("pred_null_logic", "SELECT l.doc_id, quality IS NULL AS no_quality, NOT (quality = 1) AS poor, (quality = 1 OR toxic IS NULL) AS fine FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
both("pred_in_between", "SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 5, 9, 23) OR (p_retailprice BETWEEN 1000 AND 1100) AND p_size NOT IN (2, 3)")
both("pred_like_ci", "SELECT p_partkey, p_name, p_type FROM part WHERE p_type LIKE '%brass' OR p_name LIKE '%A%' AND p_type NOT LIKE 'promo%'", "SELECT p_partkey, p_name, p_type FROM part WHERE p_type ILIKE '%brass' OR p_name ILIKE '%A%' AND p_type NOT ILIKE 'promo%'")
both("arith_cast", "SELECT p_partkey, p_size + 1 AS a, p_size * 2 - 3 AS b, ROUND(p_retailprice / 7, 6) AS c, p_size::bigint AS d, CAST(p_size AS double) / 2 AS e, p_partkey::text AS f FROM part")
both("subquery_source", "SELECT s, COUNT(*) AS n FROM (SELECT p_size AS s FROM part WHERE p_size > 10) t GROUP BY s")


@register("param_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000")
def _(e: Engine) -> DataFrame:
    return e.sql("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = $1 AND o_totalprice > $2", ["F", 200000])


@register("fn_string", """SELECT p_partkey, length(p_name) AS n, upper(p_name) AS u, lower(p_type) AS l, substring(p_name, 1, 4) AS s1,
    substring(p_name, 3) AS s2, trim(p_brand) AS t FROM part""")
def _(e: Engine) -> DataFrame:
    p = F.col("p_name")
    return e.table("part").select("p_partkey", F.length(p).cast("long").alias("n"), F.upper(p).alias("u"), F.lower("p_type").alias("l"), scalar.substring(p, -2, 4).alias("s1"), scalar.substring(p, 3).alias("s2"), scalar.trim(F.col("p_brand")).alias("t"))


@register("fn_concat_coalesce", "SELECT d.doc_id, concat(lang, ':', quality, '/', toxic) AS c, coalesce(quality, -1) AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def _(e: Engine) -> DataFrame:
    d = e.table("documents").join(e.table("labels"), "doc_id", "left")
    return d.select("doc_id", scalar.concat(F.col("lang"), F.lit(":"), F.col("quality"), F.lit("/"), F.col("toxic")).alias("c"), F.coalesce("quality", F.lit(-1)).alias("q"))


both("fn_abs", "SELECT c_custkey, abs(c_acctbal) AS a, abs(-c_nationkey) AS b FROM customer")


@register("fn_quote_ident", """SELECT n_nationkey, '"' || n_name || '"' AS q, lower(substring(n_name, 1, 1)) AS p, '"select"' AS k FROM nation""")
def _(e: Engine) -> DataFrame:
    return e.table("nation").select("n_nationkey", scalar.quote_ident(F.col("n_name")).alias("q"), scalar.quote_ident(F.lower(F.substring("n_name", 1, 1))).alias("p"), scalar.quote_ident(F.lit("select")).alias("k"))


@register("fn_format_type", "SELECT r_regionkey, CASE r_regionkey WHEN 0 THEN 'integer' WHEN 1 THEN 'text' ELSE 'character varying(12)' END AS t FROM region")
def _(e: Engine) -> DataFrame:
    oid = F.when(F.col("r_regionkey") == 0, 23).when(F.col("r_regionkey") == 1, 25).otherwise(1043)
    return e.table("region").select("r_regionkey", scalar.format_type(oid, F.lit(16)).alias("t"))


@register("fn_cast_checked", "SELECT c_custkey, c_mktsegment AS v, CAST(c_acctbal AS DOUBLE) AS d FROM customer")
def _(e: Engine) -> DataFrame:
    return e.table("customer").select("c_custkey", scalar.cast(F.col("c_mktsegment"), "varchar(32)").alias("v"), scalar.cast(F.col("c_acctbal"), "numeric").alias("d"))


@register("fn_truthy", "SELECT p_partkey FROM part WHERE (p_size - 7) <> 0 AND p_brand <> ''")
def _(e: Engine) -> DataFrame:
    return e.table("part").filter(scalar.truthy(F.col("p_size") - 7, "int") & scalar.truthy(F.col("p_brand"), "string")).select("p_partkey")


# --- joins

both("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000")
both("join_left", "SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
both("join_right", "SELECT l.quality, d.doc_id FROM labels l RIGHT JOIN documents d ON d.doc_id = l.doc_id")
both("join_full", "SELECT c_custkey, s_suppkey FROM customer FULL OUTER JOIN supplier ON c_custkey = s_suppkey + 50")
both("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
both("join_theta", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey < b.n_regionkey AND a.n_nationkey > b.n_nationkey")
both("join_null_keys", "SELECT a.doc_id AS a, b.doc_id AS b FROM (SELECT doc_id, CASE WHEN quality = 1 THEN doc_id END AS k FROM labels) a JOIN (SELECT doc_id, CASE WHEN toxic = 0 THEN doc_id END AS k FROM labels) b ON a.k = b.k")
both("join_cross_apply", "SELECT r_name, t.n_name FROM region CROSS APPLY (SELECT n_name FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey > 10) t", "SELECT r_name, t.n_name FROM region CROSS JOIN LATERAL (SELECT n_name FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey > 10) t")
both("join_outer_apply", "SELECT n_name, t.s_name FROM nation OUTER APPLY (SELECT s_name FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000) t", "SELECT n_name, t.s_name FROM nation LEFT JOIN LATERAL (SELECT s_name FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000) t ON TRUE")
both("join_lateral", "SELECT r_name, t.m FROM region JOIN LATERAL (SELECT MAX(n_nationkey) AS m FROM nation WHERE n_regionkey = r_regionkey) t")
ORACLES["join_lateral"] = "SELECT r_name, t.m FROM region, LATERAL (SELECT MAX(n_nationkey) AS m FROM nation WHERE n_regionkey = r_regionkey) t"
both("semi_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
both("anti_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
both("join_reorder_star", """SELECT n_name, COUNT(*) AS n, ROUND(SUM(l_extendedprice), 2) AS total FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    WHERE l_quantity > 30 GROUP BY n_name""")
both("join_bounded", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_orderkey LIMIT 20")


@register("exists_probe", "SELECT r_regionkey FROM region WHERE (SELECT count(*) FROM orders WHERE o_totalprice > 1000) > 0")
def _(e: Engine) -> DataFrame:
    return e.table("region").filter(F.lit(relational.exists(e.table("orders"), F.col("o_totalprice") > 1000))).select("r_regionkey")


for _hint in ("merge", "shuffle_hash", "broadcast"):

    @register(f"join_{_hint}_strategy", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0")
    def _(e: Engine, hint: str = _hint) -> DataFrame:
        c, n = e.table("customer").filter("c_acctbal > 0"), e.table("nation")
        return c.join(n.hint(hint), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


@register("fn_session", "SELECT 'public' AS s, 'UTC' AS tz, 'reader' AS u, 'x' AS c")
def _(e: Engine) -> DataFrame:
    s = Session()
    return e.spark.range(1).select(s.current_schema().alias("s"), s.current_setting("timezone").alias("tz"), s.current_user().alias("u"), s.set_config("app", "x").alias("c"))


# --- aggregation, sort, distinct, set operations

both("agg_group", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(SUM(l_quantity), 4) AS q, ROUND(AVG(l_discount), 8) AS d, MIN(l_shipdate) AS lo, MAX(l_shipdate) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus")
both("agg_having", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 15")
both("agg_global_empty", "SELECT COUNT(*) AS n, SUM(o_totalprice) AS s, MIN(o_orderkey) AS m FROM orders WHERE o_orderkey < 0")
both("agg_filtered", "SELECT COUNT(*) AS n, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS s FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag = 'N'")
both("agg_summary", "SELECT COUNT(*) AS n, MIN(o_orderkey) AS lo, MAX(o_orderkey) AS hi FROM orders")
both("agg_sum_int", "SELECT p_brand, SUM(p_size) AS s, COUNT(p_size) AS n FROM part GROUP BY p_brand", "SELECT p_brand, CAST(SUM(p_size) AS BIGINT) AS s, COUNT(p_size) AS n FROM part GROUP BY p_brand")
both("agg_expr_key", "SELECT length(p_name) AS k, COUNT(*) AS n FROM part GROUP BY length(p_name)")
ORACLES["agg_expr_key"] = "SELECT CAST(length(p_name) AS INTEGER) AS k, COUNT(*) AS n FROM part GROUP BY length(p_name)"
both("distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
both("distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")


@register("distinct_on_api", "SELECT DISTINCT ON (c_nationkey) c_nationkey, c_custkey FROM customer ORDER BY c_nationkey, c_acctbal DESC, c_custkey")
def _(e: Engine) -> DataFrame:
    return relational.distinct_on(e.table("customer"), ["c_nationkey"], [F.col("c_acctbal").desc(), F.col("c_custkey")]).select("c_nationkey", "c_custkey")


both("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
both("offset_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 40")


@register("keyset_page", "SELECT c_custkey, c_name FROM customer WHERE c_custkey > 70 ORDER BY c_custkey LIMIT 15")
def _(e: Engine) -> DataFrame:
    return relational.keyset_page(e.table("customer").select("c_custkey", "c_name"), "c_custkey", 70, 15)


both("nulls_order", "SELECT d.doc_id, row_number() OVER (ORDER BY l.quality DESC, d.doc_id) AS a, row_number() OVER (ORDER BY l.quality, d.doc_id) AS b FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id", "SELECT d.doc_id, CAST(row_number() OVER (ORDER BY l.quality DESC NULLS FIRST, d.doc_id) AS INTEGER) AS a, CAST(row_number() OVER (ORDER BY l.quality NULLS LAST, d.doc_id) AS INTEGER) AS b FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
both("set_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
both("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
both("set_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
both("set_except", "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")


@register("set_right_assoc", "SELECT n_nationkey AS k FROM nation EXCEPT (SELECT c_nationkey FROM customer WHERE c_nationkey < 15 EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey < 8)")
def _(e: Engine) -> DataFrame:
    c, s = e.table("customer").filter("c_nationkey < 15").select("c_nationkey"), e.table("supplier").filter("s_nationkey < 8").select("s_nationkey")
    return relational.set_chain(e.table("nation").select(F.col("n_nationkey").alias("k")), ("except", c), ("except", s))


# --- common table expressions

both("cte_chain", "WITH a AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey), b AS (SELECT n, COUNT(*) AS m FROM a GROUP BY n) SELECT n, m FROM b")
both("cte_recursive_union_all", "WITH RECURSIVE t(n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, f * 2 FROM t WHERE n < 20) SELECT n, f FROM t")


@register("cte_recursive_union", """WITH RECURSIVE t(k) AS (SELECT 0 UNION SELECT CAST((k * 3 + d.x) % 25 AS INTEGER) FROM t, (SELECT 1 AS x UNION ALL SELECT 2) d)
    SELECT t.k, n_name FROM t JOIN nation ON n_nationkey = t.k""")
def _(e: Engine) -> DataFrame:
    anchor = e.spark.range(1).select(F.lit(0).alias("k"))
    reach = fixpoint(anchor, lambda t: t.select(F.explode(F.array(*(((F.col("k") * 3 + x) % 25).cast("int") for x in (1, 2)))).alias("k")))
    return reach.join(e.table("nation"), F.col("k") == F.col("n_nationkey")).select("k", "n_name")


# --- windows

_W = "PARTITION BY o_custkey ORDER BY o_orderdate NULLS LAST, o_orderkey NULLS LAST"
both("win_rank_family", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey, o_orderkey) AS rn, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey) AS r, dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey) AS d FROM orders",
     "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey, o_orderkey) AS INTEGER) AS rn, CAST(rank() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey) AS INTEGER) AS r, CAST(dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey) AS INTEGER) AS d FROM orders")
both("win_lag_lead", f"SELECT o_orderkey, lag(o_totalprice) OVER ({_W}) AS a, lead(o_totalprice) OVER ({_W}) AS b FROM orders")
both("win_rows", f"SELECT o_orderkey, first_value(o_orderkey) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS a, last_value(o_orderkey) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS b FROM orders")
both("win_range", "SELECT p_partkey, first_value(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a, MIN(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS b FROM part")


@register("win_first_last_default", f"SELECT o_orderkey, first_value(o_orderkey) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a, last_value(o_orderkey) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b FROM orders")
def _(e: Engine) -> DataFrame:
    w = windows.rows(["o_custkey"], [F.col("o_orderdate").asc_nulls_last(), F.col("o_orderkey").asc_nulls_last()])
    return e.table("orders").select("o_orderkey", F.first_value("o_orderkey").over(w).alias("a"), F.last_value("o_orderkey").over(w).alias("b"))


def _frame(name: str, kind: str, exclude: str) -> None:
    word = "" if exclude == "no others" else f" EXCLUDE {exclude.upper()}"
    order = "p_size" if kind == "min" else "p_size, p_partkey"

    @register(name, f"SELECT p_partkey, {kind}(p_partkey) OVER (PARTITION BY p_brand ORDER BY {order} GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING{word}) AS v FROM part")
    def _(e: Engine) -> DataFrame:
        part = e.table("part").select("p_partkey", "p_brand", "p_size")
        keys = [F.col("p_size").asc_nulls_last()] + ([] if kind == "min" else [F.col("p_partkey").asc_nulls_last()])
        return windows.over_groups(part, ["p_brand"], keys, "p_partkey", "v", -1, 1, kind, exclude).select("p_partkey", "v")


for _name, _kind, _exclude in (("win_groups", "min", "no others"), ("win_exclude_current", "first_value", "current row"), ("win_exclude_group", "min", "group"), ("win_exclude_ties", "min", "ties"), ("win_groups_last", "last_value", "no others")):
    _frame(_name, _kind, _exclude)

# --- time series

both("ts_bucket_hour", "SELECT time_bucket('1 hour', ts) AS b, COUNT(*) AS n FROM events GROUP BY time_bucket('1 hour', ts)", "SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS b, COUNT(*) AS n FROM events GROUP BY 1")
both("ts_bucket_week", "SELECT event_id, time_bucket('1 week', ts) AS b FROM events", "SELECT event_id, time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-01') AS b FROM events")
both("ts_bucket_origin", "SELECT event_id, time_bucket('6 hours', ts, TIMESTAMP'2020-01-01 01:30:00') AS b FROM events", "SELECT event_id, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2020-01-01 01:30:00') AS b FROM events")


@register("ts_range_partition", "SELECT event_id, ts FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-09'")
def _(e: Engine) -> DataFrame:
    return timeseries.time_range(e.table("events"), "ts", "2024-01-02", "2024-01-09", {"event_type": "click"}).select("event_id", "ts")


_ROLLUP = timeseries.Rollup("by_day", "events", "1 day", "ts", ("event_type",), (("count", "*", "n"), ("min", "event_id", "first"), ("max", "event_id", "last")))
_ROLLUP_SQL = "SELECT time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS bucket, event_type, COUNT(*) AS n, MIN(event_id) AS first, MAX(event_id) AS last FROM events GROUP BY ALL"


@register("ts_rollup_build", _ROLLUP_SQL)
def _(e: Engine) -> DataFrame:
    return _ROLLUP.build(e.table("events"))


@register("ts_rollup_rewrite", _ROLLUP_SQL)
def _(e: Engine) -> DataFrame:
    store = _store(e.spark)
    store.write("events", e.table("events"))
    rollups = timeseries.Rollups(store)
    rollups.create(_ROLLUP)
    rows, name = rollups.query(_ROLLUP)
    if name != "by_day":
        raise AssertionError("the rollup was not used")
    return rows


@register("ts_retention", "SELECT event_id FROM events WHERE NOT (ts < TIMESTAMP '2024-02-01' - INTERVAL '7 days')")
def _(e: Engine) -> DataFrame:
    return timeseries.retention(e.table("events"), "ts", "7 days", "2024-02-01 00:00:00")[0].select("event_id")


@register("ts_retention_counts", "SELECT CAST(count_if(ts < TIMESTAMP '2024-02-01' - INTERVAL '7 days') AS BIGINT) AS deleted, CAST(count_if(NOT ts < TIMESTAMP '2024-02-01' - INTERVAL '7 days') AS BIGINT) AS kept, CAST(count_if(ts IS NULL) AS BIGINT) AS skipped FROM events")
def _(e: Engine) -> DataFrame:
    return timeseries.retention(e.table("events"), "ts", "7 days", "2024-02-01 00:00:00")[1]


# --- full text

_TERMS = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{Nl}\\p{N}\\p{M}]+'), lambda t: t <> '' AND NOT list_contains(['" + "','".join(search.STOP_WORDS) + "'], t))"
_QUERY = "thonent reation the erst"
_BM25 = f"""
WITH t AS (SELECT doc_id, lang, {_TERMS} AS t FROM documents),
s AS (SELECT count(*) AS n, greatest(avg(len(t)), 1) AS avgdl FROM t),
q AS (SELECT unnest(['thonent', 'reation', 'erst']) AS w),
df AS (SELECT w, count(*) FILTER (list_contains(t, w)) AS df FROM q, t GROUP BY w),
sc AS (SELECT t.doc_id, any_value(lang) AS lang, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * (len(list_filter(t, lambda x: x = w)) * 2.2
    / (len(list_filter(t, lambda x: x = w)) + 1.2 * (0.25 + 0.75 * len(t) / avgdl)))) AS score FROM t, s, df GROUP BY t.doc_id)
"""


@register("fts_match", _BM25 + "SELECT doc_id FROM sc WHERE score > 0")
def _(e: Engine) -> DataFrame:
    d = e.table("documents")
    return d.filter(search.score(d, "text", _QUERY) > 0).select("doc_id")


@register("fts_score_topk", _BM25 + "SELECT doc_id, round(score, 6) AS score FROM sc ORDER BY round(score, 6) DESC, doc_id LIMIT 20")
def _(e: Engine) -> DataFrame:
    d = e.table("documents")
    return d.select("doc_id", F.round(search.score(d, "text", _QUERY), 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


@register("fts_indexed_topk", _BM25 + "SELECT doc_id, round(score, 6) AS score FROM sc WHERE score > 0 ORDER BY round(score, 6) DESC, doc_id LIMIT 20")
def _(e: Engine) -> DataFrame:
    d = e.table("documents").withColumn("text", F.col("text"))
    c = search.corpus(d, "text", [], search.Analyzer())
    top = search.indexed_top(search.postings(d, "doc_id", "text"), "doc_id", c["n"], c["avgdl"], _QUERY, 100)
    return top.select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


@register("fts_filtered", _BM25 + "SELECT doc_id, round(score, 6) AS score FROM sc WHERE score > 0 AND lang = 'en'")
def _(e: Engine) -> DataFrame:
    d = e.table("documents")
    hit = d.filter("lang = 'en'").withColumn("score", search.score(d, "text", _QUERY, stats=d))
    return hit.filter("score > 0").select("doc_id", F.round("score", 6).alias("score"))


@register("fts_snippet", "SELECT doc_id, regexp_replace(text, '(thonent|reation|erst)', '<mark>\\1</mark>', 'gi') AS s FROM documents")
def _(e: Engine) -> DataFrame:
    return e.table("documents").select("doc_id", search.snippet(F.col("text"), _QUERY).alias("s"))


@register("fts_no_stopwords", f"SELECT doc_id, CAST(len(list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{Nl}}\\p{{N}}\\p{{M}}]+'), lambda t: t <> '')) AS BIGINT) AS all_terms, CAST(len({_TERMS}) AS BIGINT) AS terms FROM documents")
def _(e: Engine) -> DataFrame:
    n = lambda a: F.size(a.terms(F.col("text"))).cast("long")
    return e.table("documents").select("doc_id", n(search.Analyzer(stop_words=False)).alias("all_terms"), n(search.Analyzer()).alias("terms"))


@register("fts_fraction", f"SELECT doc_id, (SELECT count(*) FROM (SELECT unnest(['thonent', 'reation', 'erst']) AS w) WHERE list_contains({_TERMS}, w)) / 3.0::DOUBLE AS f FROM documents")
def _(e: Engine) -> DataFrame:
    return e.table("documents").select("doc_id", search.fraction(F.col("text"), _QUERY).alias("f"))


# --- vectors

_V = [round(((i * 37) % 64 - 32) / 100, 2) for i in range(64)]
_VSQL = "[" + ",".join(map(str, _V)) + "]::DOUBLE[]"


def _nearest(name: str, metric: str, sql: str, where: str = "true") -> None:
    @register(name, f"SELECT vec_id, round({sql.format(v='embedding::DOUBLE[]', q=_VSQL)}, 6) AS distance FROM embeddings WHERE {where} ORDER BY {sql.format(v='embedding::DOUBLE[]', q=_VSQL)}, vec_id LIMIT 10")
    def _(e: Engine) -> DataFrame:
        top = vector.top_k(e.table("embeddings").filter(where), "vec_id", "embedding", _V, 10, metric)
        return top.select("vec_id", F.round("distance", 6).alias("distance"))


for _name, _metric, _sql, _where in (
    ("vec_l2_topk", "l2", "list_distance({v}, {q})", "true"),
    ("vec_cosine_topk", "cosine", "1 - list_cosine_similarity({v}, {q})", "true"),
    ("vec_dot_topk", "dot", "-list_dot_product({v}, {q})", "true"),
    ("vec_prefilter", "l2", "list_distance({v}, {q})", "label = 1"),
):
    _nearest(_name, _metric, _sql, _where)


@register("vec_operators", f"SELECT a.vec_id AS a, b.vec_id AS b, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS l2, round(-list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dot, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id = b.vec_id - 1")
def _(e: Engine) -> DataFrame:
    return e.sql("SELECT a.vec_id AS a, b.vec_id AS b, round(a.embedding <-> b.embedding, 6) AS l2, round(a.embedding <#> b.embedding, 6) AS dot, round(a.embedding <=> b.embedding, 6) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id = b.vec_id - 1")


@register("vec_score", f"SELECT vec_id, round(1 / (1 + list_distance(embedding::DOUBLE[], {_VSQL})), 6) AS score FROM embeddings")
def _(e: Engine) -> DataFrame:
    return e.table("embeddings").select("vec_id", F.round(vector.l2_score(F.col("embedding"), vector.literal(_V)), 6).alias("score"))


@register("vec_ivf_full_probe", ORACLES["vec_l2_topk"])
def _(e: Engine) -> DataFrame:
    ivf = vector.IVF(e.table("embeddings"), "vec_id", "embedding", lists=16)
    return ivf.search(_V, 10, probes=16).select("vec_id", F.round("distance", 6).alias("distance"))


#: Probes of 16 lists, and hash tables, for a recall of at least 0.9 of the 10 nearest; tests measure it.
PROBES, TABLES = 13, 96


@register("vec_ivf_probe")
def _(e: Engine) -> DataFrame:
    return vector.IVF(e.table("embeddings"), "vec_id", "embedding", lists=16).search(_V, 10, probes=PROBES)


@register("vec_embed_local")
def _(e: Engine) -> DataFrame:
    return e.table("benchmark").select("item_id", vector.embed(F.col("text"), 16).alias("v"))


@register("hybrid_topk", _BM25 + f"SELECT doc_id, round(0.65 * score + 0.35 / (1 + list_distance(embedding::DOUBLE[], {_VSQL})), 6) AS h FROM sc JOIN embeddings ON doc_id = vec_id WHERE lang = 'en' ORDER BY h DESC, doc_id LIMIT 15")
def _(e: Engine) -> DataFrame:
    d = e.table("documents")
    scored = d.withColumn("s", search.score(d, "text", _QUERY)).filter("lang = 'en'").join(e.table("embeddings"), F.col("doc_id") == F.col("vec_id"))
    h = vector.hybrid(F.col("s"), vector.l2_score(F.col("embedding"), vector.literal(_V)))
    return scored.select("doc_id", F.round(h, 6).alias("h")).orderBy(F.desc("h"), "doc_id").limit(15)


@register("vec_planes_search")
def _(e: Engine) -> DataFrame:
    return vector.Hyperplanes(e.table("embeddings"), "vec_id", "embedding", 64, tables=TABLES).search(_V, 10)


@register("search_aggregate", _BM25 + "SELECT lang, CAST(count(*) AS BIGINT) AS n, round(max(score), 6) AS best FROM sc WHERE score > 0 GROUP BY lang")
def _(e: Engine) -> DataFrame:
    d = e.table("documents")
    hit = d.withColumn("score", search.score(d, "text", _QUERY)).filter("score > 0")
    return hit.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("score"), 6).alias("best"))


# --- graphs: nations and regions, and nations in a ring

_EDGES_SQL = """
    SELECT 'in-' || n_nationkey AS edge_id, 'nation' AS source_type, CAST(n_nationkey AS VARCHAR) AS source_id, 'region' AS target_type, CAST(n_regionkey AS VARCHAR) AS target_id, 'within' AS edge_type, CAST(1 + n_nationkey % 3 AS DOUBLE) AS weight FROM nation
    UNION ALL SELECT 'next-' || n_nationkey, 'nation', CAST(n_nationkey AS VARCHAR), 'nation', CAST((n_nationkey * 2 + 1) % 25 AS VARCHAR), 'next', CAST(2 + n_nationkey % 2 AS DOUBLE) FROM nation
    UNION ALL SELECT 'skip-' || n_nationkey, 'nation', CAST(n_nationkey AS VARCHAR), 'nation', CAST((n_nationkey + 7) % 25 AS VARCHAR), 'skip', CAST(1 + n_nationkey % 5 AS DOUBLE) FROM nation"""


def _edges(e: Engine) -> DataFrame:
    return e.sql(_EDGES_SQL.replace("VARCHAR", "string"))


@register("graph_neighbors", f"""WITH e AS ({_EDGES_SQL}) SELECT CAST(row_number() OVER (ORDER BY weight, edge_id) AS BIGINT) AS path_rank, edge_id, target_id AS node_id, weight AS cost
    FROM e WHERE source_type = 'nation' AND source_id = '3' AND edge_type IN ('next', 'skip')""")
def _(e: Engine) -> DataFrame:
    return graph.neighbors(_edges(e), "nation", "3", "out", "next,SKIP", 10).select("path_rank", "edge_id", "node_id", "cost")


@register("graph_expand", f"""WITH RECURSIVE e AS ({_EDGES_SQL}), p AS (
    SELECT 0 AS depth, CAST(0 AS DOUBLE) AS cost, 'nation' AS node_type, '3' AS node_id, CAST('' AS VARCHAR) AS edge_id, ['nation:3'] AS seen, CAST('' AS VARCHAR) AS path
    UNION ALL SELECT depth + 1, cost + weight, target_type, target_id, e.edge_id, list_append(seen, target_type || ':' || target_id), path || '/' || e.edge_id
    FROM p JOIN e ON source_type = node_type AND source_id = node_id AND NOT list_contains(seen, target_type || ':' || target_id) WHERE depth < 3)
    SELECT CAST(depth AS BIGINT) AS depth, cost, node_type, node_id, edge_id, path FROM p WHERE depth > 0""")
def _(e: Engine) -> DataFrame:
    out = graph.expand(_edges(e), "nation", "3", 3)
    steps = F.from_json("path_edges", "array<string>")
    return out.select("depth", "cost", "node_type", "node_id", "edge_id", F.concat(F.lit("/"), F.array_join(steps, "/")).alias("path"))


@register("graph_shortest_path", f"""WITH RECURSIVE e AS ({_EDGES_SQL}), p AS (
    SELECT 0 AS depth, CAST(0 AS DOUBLE) AS cost, '3' AS node_id, ['3'] AS seen
    UNION ALL SELECT depth + 1, cost + weight, target_id, list_append(seen, target_id) FROM p JOIN e ON source_type = 'nation' AND target_type = 'nation' AND source_id = node_id
        AND NOT list_contains(seen, target_id) WHERE depth < 6)
    SELECT min(cost) AS cost FROM p WHERE node_id = '19'""")
def _(e: Engine) -> DataFrame:
    return graph.shortest_path(_edges(e), "nation", "3", "nation", "19", 6).select("cost")


@register("graph_lateral", f"""WITH RECURSIVE e AS ({_EDGES_SQL}), p AS (
    SELECT n_nationkey AS start, 0 AS depth, CAST(n_nationkey AS VARCHAR) AS node_id, 'nation' AS node_type, ['nation:' || n_nationkey] AS seen FROM nation WHERE n_nationkey < 5
    UNION ALL SELECT start, depth + 1, target_id, target_type, list_append(seen, target_type || ':' || target_id) FROM p JOIN e ON source_type = node_type AND source_id = node_id
        AND NOT list_contains(seen, target_type || ':' || target_id) WHERE depth < 2)
    SELECT start, CAST(depth AS BIGINT) AS depth, node_type, node_id FROM p WHERE depth > 0""")
def _(e: Engine) -> DataFrame:
    starts = e.table("nation").filter("n_nationkey < 5").select(F.col("n_nationkey").alias("start"), F.lit("nation").alias("node_type"), F.col("n_nationkey").cast("string").alias("node_id"))
    return graph.expand_all(_edges(e), starts, 2).select("start", "depth", "node_type", "node_id")


# --- the same surface as SQL text

both("sql_param_order", "SELECT c_custkey FROM customer WHERE c_custkey > 10 AND c_custkey < 100")


@register("sql_param_order", ORACLES["sql_param_order"])
def _(e: Engine) -> DataFrame:
    return e.sql("SELECT c_custkey FROM customer WHERE c_custkey > $2 AND c_custkey < $1 AND $3 IS NULL", [100, 10])


both("sql_like_operands", "SELECT p_partkey, lower(p_name) LIKE '%A%' AS a, p_type || '!' LIKE 'promo%' AS b, p_type NOT LIKE lower('%BRASS') AS c FROM part", "SELECT p_partkey, lower(p_name) ILIKE '%A%' AS a, (p_type || '!') ILIKE 'promo%' AS b, p_type NOT ILIKE '%brass' AS c FROM part")
both("sql_distinct_on_expr", "SELECT DISTINCT ON (c_nationkey) c_nationkey, coalesce(c_name, 'x') AS n, c_acctbal * 2 AS twice FROM customer ORDER BY c_nationkey, c_acctbal DESC, c_custkey")
both("sql_set_chain", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT c_nationkey FROM customer WHERE c_nationkey < 15 EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey < 8 ORDER BY k LIMIT 20",
     "SELECT n_nationkey AS k FROM nation EXCEPT (SELECT c_nationkey FROM customer WHERE c_nationkey < 15 EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey < 8) ORDER BY k LIMIT 20")
both("sql_recursive_union", ORACLES["cte_recursive_union"])
_FRAMES = [(f, b, x) for f in ("first_value", "last_value", "min") for b in ("1 PRECEDING AND 2 FOLLOWING", "UNBOUNDED PRECEDING AND CURRENT ROW") for x in ("CURRENT ROW", "GROUP", "TIES", "NO OTHERS")]
both("sql_window_frames", "SELECT p_partkey, " + ", ".join(f"{f}(p_partkey) OVER (PARTITION BY p_brand ORDER BY {'p_size' if f == 'min' else 'p_size, p_partkey'} GROUPS BETWEEN {b} EXCLUDE {x}) AS c{i}" for i, (f, b, x) in enumerate(_FRAMES)) + " FROM part p",
     "SELECT p_partkey, " + ", ".join(f"{f}(p_partkey) OVER (PARTITION BY p_brand ORDER BY {'p_size' if f == 'min' else 'p_size, p_partkey'} GROUPS BETWEEN {b} EXCLUDE {x}) AS c{i}" for i, (f, b, x) in enumerate(_FRAMES)) + " FROM part")
both("sql_search_score", f"SELECT doc_id, round(search_score(text, '{_QUERY}'), 6) AS score FROM documents ORDER BY score DESC, doc_id LIMIT 20", ORACLES["fts_score_topk"])
both("sql_search_filter", f"SELECT doc_id FROM documents WHERE search(text, '{_QUERY}') AND lang = 'en'", _BM25 + "SELECT doc_id FROM sc WHERE score > 0 AND lang = 'en'")
both("sql_snippet", f"SELECT doc_id, snippet(text, '{_QUERY}') AS s FROM documents", "SELECT doc_id, regexp_replace(text, '(thonent|reation|erst)', '<mark>\\1</mark>', 'gi') AS s FROM documents")
_VTEXT = "'[" + ",".join(map(str, _V)) + "]'"
both("sql_vector_topk", f"SELECT vec_id, round(vector_distance(embedding, {_VTEXT}), 6) AS distance FROM embeddings ORDER BY vector_distance(embedding, {_VTEXT}), vec_id LIMIT 10", ORACLES["vec_l2_topk"])
both("sql_vector_functions", f"SELECT vec_id, round(vector_score(embedding, {_VTEXT}), 6) AS s, round(cosine_distance(embedding, {_VTEXT}), 6) AS c, round(dot_product(embedding, {_VTEXT}), 6) AS d, round(embedding <-> {_VTEXT}, 6) AS l FROM embeddings",
     f"SELECT vec_id, round(1 / (1 + list_distance(embedding::DOUBLE[], {_VSQL})), 6) AS s, round(1 - list_cosine_similarity(embedding::DOUBLE[], {_VSQL}), 6) AS c, round(-list_dot_product(embedding::DOUBLE[], {_VSQL}), 6) AS d, round(list_distance(embedding::DOUBLE[], {_VSQL}), 6) AS l FROM embeddings")
both("sql_hybrid_topk", f"SELECT doc_id, round(hybrid_score(search_score(text, '{_QUERY}'), vector_score(embedding, {_VTEXT})), 6) AS h FROM documents JOIN embeddings ON doc_id = vec_id WHERE lang = 'en' ORDER BY h DESC, doc_id LIMIT 15", ORACLES["hybrid_topk"])
both("sql_scalar_calls", "SELECT n_nationkey, substring(n_name, -1, 3) AS s, quote_ident(n_name) AS q, format_type(23, NULL) AS t, concat(n_name, NULL, 1) AS c, cast(n_name AS varchar(40)) AS v, current_setting('timezone') AS z FROM nation",
     """SELECT n_nationkey, substring(n_name, 1, 3) AS s, '"' || n_name || '"' AS q, 'integer' AS t, n_name || '1' AS c, n_name AS v, 'UTC' AS z FROM nation""")


def _graph(name: str, text: str, oracle: str) -> None:
    @register(name, oracle)
    def _(e: Engine) -> DataFrame:
        e.create_graph("nations", _edges(e))
        return e.sql(text)


_graph("sql_graph_neighbors", "SELECT path_rank, edge_id, node_id, cost FROM graph_neighbors('nations', 'nation', '3', 'out', 'next,SKIP', 10) g", ORACLES["graph_neighbors"])
_graph("sql_graph_expand", "SELECT node_type, count(*) AS n, sum(cost) AS c FROM graph_expand('nations', 'nation', '3', 3, 'out', '*', 1000) GROUP BY node_type",
       ORACLES["graph_expand"].rsplit("SELECT CAST(depth", 1)[0] + "SELECT node_type, count(*) AS n, sum(cost) AS c FROM p WHERE depth > 0 GROUP BY node_type")
_graph("sql_graph_paths", "SELECT path_rank, cost FROM graph_shortest_path('nations', 'nation', '3', 'nation', '19', 4, 'out', '*', 3)",
       ORACLES["graph_shortest_path"].replace("depth < 6", "depth < 4").replace("SELECT min(cost) AS cost FROM p WHERE node_id = '19'", "SELECT CAST(row_number() OVER (ORDER BY cost) AS BIGINT) AS path_rank, cost FROM (SELECT cost FROM p WHERE node_id = '19' ORDER BY cost LIMIT 3)").replace("ON source_type = 'nation' AND target_type = 'nation' AND source_id = node_id", "ON source_type = 'nation' AND target_type = 'nation' AND source_id = node_id AND node_id <> '19'"))
_graph("sql_graph_lateral", "SELECT n.n_nationkey AS start, g.depth, g.node_type, g.node_id FROM nation n CROSS JOIN LATERAL graph_expand('nations', 'nation', n.n_nationkey, 2) g WHERE n.n_nationkey < 5", ORACLES["graph_lateral"])


def _statements(name: str, oracle: str, *texts: str, columns: tuple[str, ...] = ("*",)) -> None:
    """A query over a fresh database after some statements."""

    @register(name, oracle)
    def _(e: Engine) -> DataFrame:
        db = Database(_store(e.spark))
        for t in ("nation", "region", "events"):
            if any(f"source_{t}" in x for x in texts):
                e.table(t).createOrReplaceTempView(f"source_{t}")
        for t in texts[:-1]:
            db.execute(t)
        return db.execute(texts[-1]).select(*columns)


_NATIONS = ("CREATE TABLE nations (k INT PRIMARY KEY, name TEXT NOT NULL, region INT DEFAULT 0, CHECK (k >= 0))", "INSERT INTO nations SELECT n_nationkey, n_name, n_regionkey FROM source_nation WHERE n_nationkey < 20")
_statements("sql_insert_returning", "SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_nationkey >= 20", *_NATIONS, "INSERT INTO nations (k, name) SELECT n_nationkey, n_name FROM source_nation WHERE n_nationkey >= 20 RETURNING k, name")
_statements("sql_upsert_where", "SELECT n_nationkey AS k, CASE WHEN n_nationkey BETWEEN 10 AND 19 AND n_regionkey > 1 THEN upper(n_name) || '!' ELSE n_name END AS name, n_regionkey AS region FROM nation", *_NATIONS,
            "INSERT INTO nations SELECT n_nationkey, upper(n_name), n_regionkey FROM source_nation WHERE n_nationkey >= 10 AND n_nationkey < 20 ON CONFLICT (k) DO UPDATE SET name = concat(excluded.name, '!') WHERE nations.region > 1",
            "INSERT INTO nations SELECT n_nationkey, n_name, n_regionkey FROM source_nation ON CONFLICT (k) DO NOTHING", "SELECT * FROM nations")
_statements("sql_update_returning", "SELECT n_nationkey AS k, 'x' || n_name AS name FROM nation WHERE n_nationkey < 20 AND n_regionkey = 2", *_NATIONS, "UPDATE nations SET name = concat('x', name) WHERE region = 2 RETURNING k, name")
_statements("sql_delete_returning", "SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 20 AND n_regionkey = 1", *_NATIONS, "DELETE FROM nations WHERE region = 1 RETURNING k")
_statements("sql_update_cascade", "SELECT n_nationkey AS k, CASE WHEN n_regionkey = 1 THEN 9 ELSE n_regionkey END AS region FROM nation WHERE n_nationkey < 20",
            "CREATE TABLE regions (r INT PRIMARY KEY, label TEXT)", "INSERT INTO regions SELECT r_regionkey, r_name FROM source_region", "CREATE TABLE nations (k INT PRIMARY KEY, name TEXT, region INT REFERENCES regions (r) ON UPDATE CASCADE ON DELETE CASCADE)", _NATIONS[1], "UPDATE regions SET r = 9 WHERE r = 1", "SELECT k, region FROM nations")
_statements("sql_transaction", "SELECT CAST(count(*) AS BIGINT) AS n FROM nation WHERE n_nationkey < 20 AND n_nationkey <> 3", *_NATIONS, "BEGIN", "DELETE FROM nations WHERE k = 3", "SAVEPOINT s", "DELETE FROM nations WHERE k > 5", "ROLLBACK TO SAVEPOINT s", "COMMIT", "SELECT COUNT(*) AS n FROM nations")
_statements("sql_alter_table", "SELECT n_nationkey AS id, n_name AS name, 7 AS size FROM nation WHERE n_nationkey < 20", *_NATIONS, "ALTER TABLE nations ADD COLUMN size INT DEFAULT 7", "ALTER TABLE nations RENAME COLUMN k TO id", "ALTER TABLE nations DROP COLUMN region", "ALTER TABLE nations ADD CONSTRAINT u UNIQUE (name)", "ALTER TABLE nations RENAME TO lands", "SELECT id, name, size FROM lands")
_statements("sql_rollup", "SELECT event_type, CAST(sum(n) AS BIGINT) AS n, max(last) AS last FROM (" + _ROLLUP_SQL + ") GROUP BY event_type", "CREATE TABLE ev (event_id BIGINT, event_type TEXT, ts TIMESTAMP)", "CREATE ROLLUP daily ON ev USING time_bucket('1 day', ts) GROUP BY event_type AGGREGATES COUNT(*) AS n, MAX(event_id) AS last",
            "INSERT INTO ev SELECT event_id, event_type, ts FROM source_events", "SELECT event_type, SUM(n) AS n, MAX(last) AS last FROM daily GROUP BY event_type")
_statements("sql_retention_policy", "SELECT CAST(count_if(ts < TIMESTAMP '2024-02-01' - INTERVAL '7 days') AS BIGINT) AS deleted, CAST(count_if(NOT ts < TIMESTAMP '2024-02-01' - INTERVAL '7 days') AS BIGINT) AS kept, CAST(count_if(ts IS NULL) AS BIGINT) AS skipped FROM events",
            "CREATE TABLE ev (event_id BIGINT, ts TIMESTAMP)", "INSERT INTO ev SELECT event_id, ts FROM source_events", "CREATE RETENTION POLICY p ON ev USING ts RETAIN FOR '7 days'", "ENFORCE RETENTION POLICY p AT '2024-02-01 00:00:00'")
_statements("sql_create_graph", "SELECT CAST(n_nationkey AS VARCHAR) AS node_id FROM nation WHERE n_regionkey = 1", "CREATE GRAPH places (NODES (label TEXT), EDGES (note TEXT))",
            "INSERT INTO places_edges SELECT concat('e', n_nationkey), 'nation', cast(n_nationkey AS text), 'region', cast(n_regionkey AS text), 'within', 1.0, NULL FROM source_nation", "SELECT node_id FROM graph_neighbors('places', 'region', '1', 'in', 'within', 100)")
_statements("sql_diff_page", "SELECT row_id, CASE WHEN k >= 20 THEN 'removed' ELSE 'changed' END AS change, FALSE AS complete, max(row_id) OVER () AS next_cursor FROM (SELECT n_nationkey AS k, CAST(n_nationkey AS VARCHAR) AS row_id FROM nation WHERE n_nationkey >= 20 OR n_regionkey = 2 ORDER BY 2 LIMIT 4)", _NATIONS[0], "INSERT INTO nations SELECT n_nationkey, n_name, n_regionkey FROM source_nation",
            "CREATE MATERIALIZED PROJECTION a AS SELECT k, name FROM nations", "DELETE FROM nations WHERE k >= 20", "UPDATE nations SET name = 'q' WHERE region = 2", "CREATE MATERIALIZED PROJECTION b AS SELECT k, name FROM nations", "DIFF PROJECTION a WITH b LIMIT 4", columns=("row_id", "change", "complete", "next_cursor"))
_statements("sql_function_procedure", "SELECT n_nationkey * 2 AS d FROM nation WHERE n_nationkey < 20 AND n_regionkey = 3", *_NATIONS, "CREATE FUNCTION twice(x INT) RETURNS INT IMMUTABLE AS 'x * 2'", "CREATE PROCEDURE of_region(r INT) AS 'SELECT twice(k) AS d FROM nations WHERE region = r'", "CALL of_region(3)")


@register("fts_stored_topk", ORACLES["fts_indexed_topk"])
def _(e: Engine) -> DataFrame:
    index = search.TextIndex(e.spark, f"{shared_dir(e.spark)}/text-index-{uuid.uuid4().hex}").build(e.table("documents"), "doc_id", "text")
    return index.search(_QUERY, 100).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


@register("replay_lag", "SELECT CAST((max(event_id) + min(event_id)) // 2 AS BIGINT) AS applied_position, max(event_id) AS source_position, CAST(count_if(event_id > (SELECT (max(event_id) + min(event_id)) // 2 FROM events)) AS BIGINT) AS waiting, FALSE AS fresh FROM events")
def _(e: Engine) -> DataFrame:
    events = e.table("events").select(F.col("event_id").cast("string").alias("event_id"), F.col("event_id").cast("string").alias("checkpoint"), F.col("event_id").alias("position"), F.col("user_id").cast("string").alias("document_id"), F.col("props").alias("payload"))
    replay = Replay(_store(e.spark), "users")
    ends = events.agg(F.max("position").alias("high"), F.min("position").alias("low")).first()
    replay.apply(events.filter(F.col("position") <= (ends["high"] + ends["low"]) // 2), "first")
    return replay.lag(events)


# --- projections, replay, DML, catalog

_CUSTOMERS_2 = "SELECT c_custkey, c_name, CASE WHEN c_custkey % 10 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 7 <> 0"


@register("proj_diff", f"WITH a AS (SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 11 <> 0), b AS ({_CUSTOMERS_2}) SELECT CAST(coalesce(a.c_custkey, b.c_custkey) AS VARCHAR) AS row_id, CASE WHEN a.c_custkey IS NULL THEN 'added' WHEN b.c_custkey IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.c_custkey = b.c_custkey WHERE a.c_custkey IS NULL OR b.c_custkey IS NULL OR a.c_acctbal <> b.c_acctbal")
def _(e: Engine) -> DataFrame:
    a = e.sql("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 11 <> 0")
    return projections.diff(a, e.sql(_CUSTOMERS_2), ["c_custkey"]).select("row_id", "change")


@register("proj_verify", "SELECT 'segments' AS projection, TRUE AS ok, CAST(count(DISTINCT c_mktsegment) AS BIGINT) AS rows FROM customer")
def _(e: Engine) -> DataFrame:
    store = _store(e.spark)
    store.write("customer", e.table("customer"))
    views = projections.Projections(store)
    views.create("segments", "SELECT c_mktsegment, COUNT(*) AS n FROM customer GROUP BY c_mktsegment", ["customer"], e.sql)
    out = views.verify("segments", "full")
    return e.spark.createDataFrame([(out["projection"], out["ok"], out["rows"])], "projection string, ok boolean, rows long")


@register("proj_substitute", "SELECT c_custkey, c_name FROM customer")
def _(e: Engine) -> DataFrame:
    store = _store(e.spark)
    store.write("customer", e.table("customer"))
    views = projections.Projections(store)
    views.create("narrow", "SELECT c_custkey, c_name, c_nationkey FROM customer", ["customer"], e.sql)
    rows, name = views.substitute("customer", ["c_custkey", "c_name"])
    if name != "narrow":
        raise AssertionError("the projection was not used")
    return rows


@register("proj_repair", "SELECT c_nationkey, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY 1")
def _(e: Engine) -> DataFrame:
    store = _store(e.spark)
    store.write("customer", e.table("customer").filter("c_custkey < 50"))
    views = projections.Projections(store)
    build = lambda q: store.read("customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    views.create("nations", "SELECT c_nationkey, n FROM customer", ["customer"], build)
    store.write("customer", e.table("customer"))
    views.repair("nations")
    return views.read("nations")


@register("ts_index_layout", "SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-05'")
def _(e: Engine) -> DataFrame:
    path = f"{shared_dir(e.spark)}/events-{uuid.uuid4().hex}"
    timeseries.write_partitioned(e.table("events").select("event_id", "event_type", "ts"), path, "ts", ["event_type"])
    rows = timeseries.time_range(e.spark.read.parquet(path), "ts", "2024-01-02", "2024-01-05").filter("day >= DATE'2024-01-02' AND day < DATE'2024-01-05'")
    return rows.select("event_id", "event_type")


@register("replay_apply", "SELECT CAST(user_id AS VARCHAR) AS document_id, max_by(props, event_id) AS payload, max(event_id) AS position FROM events GROUP BY user_id HAVING max_by(event_type, event_id) <> 'error'")
def _(e: Engine) -> DataFrame:
    events = e.table("events").select(F.col("event_id").cast("string").alias("event_id"), F.col("event_id").cast("string").alias("checkpoint"), F.col("event_id").alias("position"), F.col("user_id").cast("string").alias("document_id"), F.when(F.col("event_type") != "error", F.col("props")).alias("payload"))
    replay = Replay(_store(e.spark), "users")
    middle = events.agg(F.percentile_approx("position", 0.5)).first()[0]
    replay.apply(events.filter(F.col("position") <= middle), "first")
    replay.apply(events.filter(F.col("position") > middle), "second")
    replay.apply(events.filter(F.col("position") > middle), "again")
    return replay.rows()


def _database(e: Engine) -> Database:
    db = Database(_store(e.spark))
    db.create_table("nations", "k int, name string, region int", primary_key=("k",), not_null={"name"}, checks=["k >= 0"], defaults={"region": "0"})
    db.insert("nations", e.table("nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).filter("k < 20"))
    return db


@register("upsert_do_update", "SELECT n_nationkey AS k, CASE WHEN n_nationkey BETWEEN 10 AND 19 THEN upper(n_name) || '!' ELSE n_name END AS name, n_regionkey AS region FROM nation")
def _(e: Engine) -> DataFrame:
    db = _database(e)
    new = e.table("nation").filter("n_nationkey >= 10").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    db.insert("nations", new, ("k",), {"name": "concat(upper(excluded.name), '!')"})
    return db.read("nations")


@register("upsert_do_nothing", "SELECT n_nationkey AS k, n_name AS name, CASE WHEN n_nationkey < 20 THEN n_regionkey ELSE 0 END AS region FROM nation")
def _(e: Engine) -> DataFrame:
    db = _database(e)
    db.insert("nations", e.table("nation").filter("n_nationkey >= 10").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")), ("k",))
    return db.read("nations")


@register("dml_update", "SELECT n_nationkey AS k, CASE WHEN n_regionkey = 2 THEN 'x' ELSE n_name END AS name, n_regionkey AS region FROM nation WHERE n_nationkey < 20")
def _(e: Engine) -> DataFrame:
    db = _database(e)
    db.update("nations", {"name": "'x'"}, "region = 2")
    return db.read("nations")


@register("dml_delete_cascade", "SELECT 'c' AS t, n_nationkey AS k FROM nation WHERE n_nationkey < 20 AND n_regionkey <> 1 UNION ALL SELECT 'r', r_regionkey FROM region WHERE r_regionkey <> 1")
def _(e: Engine) -> DataFrame:
    db = _database(e)
    db.create_table("regions", "r int, name string", primary_key=("r",))
    db.insert("regions", e.table("region").select(F.col("r_regionkey").alias("r"), F.col("r_name").alias("name")))
    db.tables["nations"].foreign_keys.append(ForeignKey("region", "regions", "r", "cascade"))
    db.delete("regions", "r = 1")
    return db.read("nations").select(F.lit("c").alias("t"), "k").union(db.read("regions").select(F.lit("r"), "r"))


@register("transaction_savepoint", "SELECT CAST(count(*) AS BIGINT) AS n FROM nation WHERE n_nationkey < 20 AND n_nationkey <> 3")
def _(e: Engine) -> DataFrame:
    db = _database(e)
    db.begin()
    db.delete("nations", "k = 3")
    db.savepoint("s")
    db.delete("nations", "k > 5")
    db.rollback_to("s")
    db.commit()
    return db.read("nations").agg(F.count(F.lit(1)).alias("n"))


@register("udf_scalar", "SELECT o_orderkey, round(o_totalprice * 1.1, 4) AS gross FROM orders")
def _(e: Engine) -> DataFrame:
    Database(_store(e.spark)).create_function("with_tax", "p DOUBLE, rate DOUBLE", "DOUBLE", "p * (1 + rate)")
    return e.sql("SELECT o_orderkey, round(with_tax(o_totalprice, 0.1D), 4) AS gross FROM orders")


@register("procedure_call", "SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 20 AND n_regionkey = 3")
def _(e: Engine) -> DataFrame:
    db = _database(e)
    db.create_procedure("of_region", "SELECT k FROM nations WHERE region = $1")
    return db.call("of_region", 3)


@register("catalog_columns", "SELECT * FROM (VALUES ('nations', 'k', 1, 'int', 'NO', NULL), ('nations', 'name', 2, 'string', 'NO', NULL), ('nations', 'region', 3, 'int', 'YES', '0')) v(table_name, column_name, ordinal_position, data_type, is_nullable, column_default)")
def _(e: Engine) -> DataFrame:
    return _database(e).information_schema("columns")


@register("view_source", "SELECT n_regionkey AS region, count(*) AS n FROM nation WHERE n_nationkey < 20 GROUP BY 1")
def _(e: Engine) -> DataFrame:
    db = _database(e)
    db.create_view("per_region", "SELECT region, COUNT(*) AS n FROM nations GROUP BY region")
    return db.sql("SELECT region, n FROM per_region")


@register("copy_csv", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS c_name FROM customer")
def _(e: Engine) -> DataFrame:
    path = f"{shared_dir(e.spark)}/csv-{uuid.uuid4().hex}"
    e.table("customer").select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_name")).alias("c_name")).write.csv(path, header=True, nullValue=r"\N", quote='"', escape='"')
    return copy_csv(e.spark, path, "c_custkey long, c_name string")


@register("backup_restore", "SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_nationkey < 20")
def _(e: Engine) -> DataFrame:
    db = _database(e)
    path = f"{shared_dir(e.spark)}/backup-{uuid.uuid4().hex}"
    db.store.backup(path)
    other = _store(e.spark)
    other.restore(path)
    return other.read("nations").select("k", "name")
