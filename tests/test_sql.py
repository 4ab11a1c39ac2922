"""The dialect as SQL text: rewriting, and statements on a database."""

import uuid

import pytest

from quillmark.plans.dialect import DialectError, translate
from quillmark.session import Engine
from quillmark.sources.catalog import ConstraintError, Database
from quillmark.sources.tables import ConflictError, Store

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, SF)


@pytest.fixture
def db(spark, tmp_path):
    return Database(Store(spark, f"file://{tmp_path}/{uuid.uuid4().hex}"))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_parameters_go_by_number(engine):
    text = "SELECT c_custkey FROM customer WHERE c_custkey > $2 AND c_custkey < $1 AND ($1 > $2) AND $3 IS NULL"
    assert rows(engine.sql(text, [100, 10])) == [(k,) for k in range(11, 100)]
    assert engine.sql("SELECT 1 AS a WHERE 1 = $1").count() == 0
    assert engine.sql("SELECT '$1' AS a, \"n_name\" FROM nation LIMIT 1").first()["a"] == "$1"


def test_like_takes_any_operand(engine):
    got = engine.sql("SELECT n_name FROM nation WHERE lower(n_name) LIKE 'B%' OR concat(n_name, '_x') LIKE $1 OR n_name || 'q' LIKE '%DQ'", ["%nA_X"])
    want = [r["n_name"] for r in engine.table("nation").collect()]
    want = sorted((n,) for n in want if n.lower().startswith("b") or f"{n}_x".lower().endswith("na_x") or f"{n}q".lower().endswith("dq"))
    assert rows(got) == want
    assert engine.sql("SELECT 'a%b' LIKE 'a%b' AS x, 'axb' LIKE 'a%b' AS y, 'a_b' LIKE 'a_b' AS z, 'axb' NOT LIKE 'A_B' AS w").first() == (True, False, True, True)


def test_distinct_on_with_expressions(engine):
    got = engine.sql("SELECT DISTINCT ON (c_nationkey) c_nationkey, coalesce(c_name, 'x'), c.c_custkey AS k FROM customer c ORDER BY c_nationkey, c_acctbal DESC, c_custkey")
    first = {}
    for r in engine.table("customer").orderBy("c_acctbal", ascending=False).collect():
        first.setdefault(r["c_nationkey"], (r["c_nationkey"], r["c_name"], r["c_custkey"]))
    assert got.columns == ["c_nationkey", "column2", "k"] and rows(got) == sorted(first.values())
    with pytest.raises(DialectError):
        engine.sql("SELECT DISTINCT ON (c_nationkey) c_nationkey FROM customer ORDER BY c_custkey")


def test_sets_are_read_from_the_right(engine):
    got = engine.sql("SELECT r_regionkey AS k FROM region EXCEPT SELECT n_regionkey FROM nation WHERE n_regionkey < 3 EXCEPT SELECT r_regionkey FROM region WHERE r_regionkey < 2 ORDER BY k DESC LIMIT 2")
    assert [r["k"] for r in got.collect()] == [4, 3]
    got = engine.sql("SELECT 1 AS k INTERSECT SELECT 2 UNION SELECT 1")
    assert rows(got) == [(1,)]


def brute(values, low, high, exclude, kind):
    """Frames by GROUPS over (order, value) rows in order."""
    ranks = sorted({o for o, _ in values})
    out = []
    for i, (o, _) in enumerate(values):
        g = ranks.index(o)
        frame = [j for j, (p, _) in enumerate(values) if (low is None or ranks.index(p) >= g + low) and (high is None or ranks.index(p) <= g + high)]
        drop = {"no others": set(), "current row": {i}, "group": {j for j in frame if values[j][0] == o}, "ties": {j for j in frame if values[j][0] == o and j != i}}[exclude]
        left = [values[j][1] for j in frame if j not in drop]
        out.append((left[0] if kind == "first_value" else left[-1] if kind == "last_value" else min(left)) if left else None)
    return out


@pytest.mark.parametrize("bounds", ["1 PRECEDING AND 1 FOLLOWING", "UNBOUNDED PRECEDING AND CURRENT ROW", "2 PRECEDING AND 1 PRECEDING", "CURRENT ROW AND UNBOUNDED FOLLOWING"])
def test_group_frames_and_exclusions(engine, spark, bounds):
    data = [(0, 5), (0, 3), (1, 9), (1, 9), (1, 2), (4, 7), (7, 1), (7, 8)]
    spark.createDataFrame([(k, o, v) for k, (o, v) in enumerate(data)], "k int, o int, v int").createOrReplaceTempView("frames")
    low, high = (-1, 1) if "1 F" in bounds else (None, 0) if bounds.startswith("UNB") else (-2, -1) if "2 P" in bounds else (0, None)
    calls = [(f, e) for f in ("first_value", "last_value", "min") for e in ("no others", "current row", "group", "ties")]
    # Peers have no order of their own, so rows are numbered by k as well: one partition, ordered by o; k breaks no tie.
    text = ", ".join(f"{f}(v) OVER (ORDER BY o GROUPS BETWEEN {bounds} EXCLUDE {e}) AS c{i}" for i, (f, e) in enumerate(calls) if f == "min")
    got = sorted(engine.sql(f"SELECT k, {text} FROM frames").collect())
    for i, (f, e) in enumerate(calls):
        if f == "min":
            assert [r[f"c{i}"] for r in got] == brute(data, low, high, e, f), (f, e)
    distinct = [(o, v) for o, v in enumerate([5, 3, 9, 2, 7])]
    spark.createDataFrame([(o, v) for o, v in distinct], "o int, v int").createOrReplaceTempView("single")
    text = ", ".join(f"{f}(v) OVER (ORDER BY o GROUPS BETWEEN {bounds} EXCLUDE {e}) AS c{i}" for i, (f, e) in enumerate(calls))
    got = sorted(engine.sql(f"SELECT o, {text} FROM single s").collect())
    for i, (f, e) in enumerate(calls):
        assert [r[f"c{i}"] for r in got] == brute(distinct, low, high, e, f), (f, e)


def test_windows_share_numbers_and_frames(engine, spark):
    """Windows of one order are sorted for once, and no frame goes through all that follows for each row."""
    spark.createDataFrame([(k, k % 3, k % 7) for k in range(40)], "k int, o int, v int").createOrReplaceTempView("shared_frames")
    calls = [f"{f}(v) OVER (PARTITION BY o ORDER BY v GROUPS BETWEEN {b} EXCLUDE {x}) AS c{i}{j}{f}" for f in ("first_value", "min") for i, b in enumerate(("1 PRECEDING AND UNBOUNDED FOLLOWING", "UNBOUNDED PRECEDING AND CURRENT ROW")) for j, x in enumerate(("CURRENT ROW", "GROUP", "TIES", "NO OTHERS"))]
    plan = engine.sql("SELECT k, " + ", ".join(calls) + " FROM shared_frames")._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Window [" in x for x in plan.splitlines()) <= 6
    assert plan.count("windowspecdefinition") <= 20 and "unboundedfollowing" not in plan


def test_rows_and_range_frames_with_exclusions(engine, spark):
    spark.createDataFrame([(0, 5), (1, 3), (2, 9), (3, 2)], "o int, v int").createOrReplaceTempView("single")
    got = engine.sql("SELECT o, last_value(v) OVER (ORDER BY o ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE CURRENT ROW) AS a, min(v) OVER (ORDER BY o RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE GROUP) AS b FROM single")
    assert rows(got) == [(0, 3, 3), (1, 9, 5), (2, 2, 2), (3, 9, 9)]


def test_recursive_union_in_text(engine):
    got = engine.sql("WITH RECURSIVE t(k) AS (SELECT 0 UNION SELECT (k * 3 + 1) % 25 FROM t) SELECT n_name FROM t JOIN nation ON n_nationkey = t.k")
    seen, k = set(), 0
    while k not in seen:
        seen.add(k)
        k = (k * 3 + 1) % 25
    assert got.count() == len(seen)
    for bad in ("SELECT k FROM t UNION SELECT 1", "SELECT 1 UNION SELECT a.k FROM t a JOIN t b ON a.k = b.k", "SELECT 1"):
        with pytest.raises(DialectError):
            engine.sql(f"WITH RECURSIVE t(k) AS ({bad if bad != 'SELECT 1' else 'SELECT k FROM t'}) SELECT * FROM t")


def test_search_and_vectors_in_text(engine):
    from pyspark.sql import functions as F

    from quillmark.functions import search

    d = engine.table("documents")
    word = max(d.first()["text"].lower().replace(".", " ").replace(",", " ").split(), key=len)
    want = {r["doc_id"]: r["s"] for r in d.select("doc_id", search.score(d, "text", f"the {word}").alias("s")).collect() if r["s"] > 0}
    got = engine.sql(f"SELECT doc_id, search_score(text, 'the {word}') AS s FROM documents d WHERE search(d.text, $1)", [f"the {word}"])
    assert {r["doc_id"]: pytest.approx(r["s"]) for r in got.collect()} == want
    assert want and engine.sql(f"SELECT snippet(text, '{word}') AS s FROM documents WHERE search(text, '{word}') LIMIT 1").first()["s"].lower().count(f"<mark>{word}</mark>") >= 1
    got = engine.sql("SELECT vector_distance('[3,4]', $1) AS a, '[3,4]' <-> '[0,0]' AS b, cosine_distance('[1,0]', '[0,1]') AS c, dot_product('[1,2]', '[3,4]') AS d, vector_score('[3,4]', '[0,0]') AS e", [[0.0, 0.0]]).first()
    assert tuple(got) == pytest.approx((5, 5, 1, -11, 1 / 6))
    assert engine.sql("SELECT hybrid_score(search_score(text, 'nosuchword'), 1) AS h FROM documents").agg(F.min("h")).first()[0] == pytest.approx(0.35)
    with pytest.raises(Exception, match="differ in length"):
        engine.sql("SELECT vector_distance('[3,4]', '[1]') AS a").collect()


def test_graph_functions_are_sources(engine, spark):
    edges = [("a", "p", "1", "p", "2", "knows", 1.0), ("b", "p", "2", "p", "3", "knows", 1.0), ("c", "p", "1", "p", "3", "knows", 5.0), ("d", "p", "1", "p", "3", "knows", 2.5)]
    engine.create_graph("social", spark.createDataFrame(edges, "edge_id string, source_type string, source_id string, target_type string, target_id string, edge_type string, weight double"))
    assert rows(engine.sql("SELECT node_id, cost FROM graph_neighbors('social', 'p', '1', 'out', 'knows', 2) n ORDER BY cost")) == [("2", 1.0), ("3", 2.5)]
    assert engine.sql("SELECT * FROM graph_expand('social', 'p', '1', 2, 'out', '*', 10)").count() == 4
    assert rows(engine.sql("SELECT path_rank, cost FROM graph_shortest_path('social', 'p', '1', 'p', '3', 3, 'out', 'knows', 2)")) == [(1, 2.0), (2, 2.5)]
    spark.createDataFrame([("1",), ("2",)], "k string").createOrReplaceTempView("starts")
    got = engine.sql("SELECT s.k, e.node_id FROM starts s CROSS JOIN LATERAL graph_expand('social', 'p', s.k, 1) e")
    assert rows(got) == [("1", "2"), ("1", "3"), ("1", "3"), ("2", "3")]


def test_scalar_and_session_functions_in_text(engine):
    got = engine.sql("SELECT substring('abcdef', -2, 3) AS a, quote_ident('a b') AS b, quote_ident('ab') AS c, format_type(1043, 16) AS d, current_setting('timezone') AS e, set_config('app', 'x', false) AS f, current_schema() AS g, len('abc') AS h, cast('abc' AS varchar(3)) AS i, '5'::int8 AS j").first()
    assert tuple(got) == ("abc", '"a b"', "ab", "character varying(12)", "UTC", "x", "public", 3, "abc", 5)
    assert engine.sql("SELECT version() AS v, current_user AS u, pg_backend_pid() > 0 AS p, has_table_privilege('a', 'b') AS h").first()["p"]
    assert engine.sql("SELECT * FROM pg_show_all_settings() WHERE name = 'app'").first()["setting"] == "x"
    with pytest.raises(Exception, match="too long"):
        engine.sql("SELECT cast('abcd' AS varchar(3)) AS i").collect()


def test_dml_as_statements(db):
    db.execute("CREATE TABLE docs (id INT PRIMARY KEY, tenant TEXT NOT NULL, title VARCHAR(20) DEFAULT 'none', score INT CHECK (score >= 0), UNIQUE (tenant, title))")
    db.execute("CREATE TABLE IF NOT EXISTS docs (id INT)")
    got = db.execute("INSERT INTO docs (id, tenant, score) VALUES (1, 'a', $1), (2, 'b', 20) RETURNING id, title", [10])
    assert rows(got) == [(1, "none"), (2, "none")]
    got = db.execute("INSERT INTO docs VALUES (2, 'b', 'new', 5), (3, 'c', 'x', 1) ON CONFLICT (id) DO UPDATE SET title = excluded.title, score = docs.score + excluded.score WHERE excluded.score < score RETURNING id, score")
    assert rows(got) == [(2, 25), (3, 1)]
    db.execute("INSERT INTO docs (id, tenant, title, score) SELECT id, tenant, 'again', 0 FROM docs ON CONFLICT (id) DO NOTHING")
    assert rows(db.execute("SELECT id, title, score FROM docs")) == [(1, "none", 10), (2, "new", 25), (3, "x", 1)]
    assert rows(db.execute("UPDATE docs SET score = score + $1, title = upper(title) WHERE tenant LIKE 'A%' RETURNING id, score, title", [5])) == [(1, 15, "NONE")]
    assert rows(db.execute("DELETE FROM docs WHERE id = 3 RETURNING *")) == [(3, "c", "x", 1)]
    for bad in ("INSERT INTO docs VALUES (1, 'z', 'q', 1)", "INSERT INTO docs VALUES (9, NULL, 'q', 1)", "INSERT INTO docs VALUES (9, 'z', 'q', -1)", "INSERT INTO docs VALUES (9, 'b', 'new', 1)"):
        with pytest.raises(ConstraintError):
            db.execute(bad)
    with pytest.raises(DialectError):
        db.execute("INSERT INTO docs VALUES (1, 'a', 'b', 1) ON CONFLICT (score) DO NOTHING")


def test_transactions_as_statements(db):
    db.execute("CREATE TABLE t (k INT PRIMARY KEY)")
    db.execute("CREATE TABLE u (k INT)")
    db.execute("BEGIN")
    db.execute("INSERT INTO t VALUES (1), (2)")
    db.execute("SAVEPOINT s")
    db.execute("DELETE FROM t WHERE k = 1")
    db.execute("ROLLBACK TO SAVEPOINT s")
    db.execute("INSERT INTO u VALUES (7)")
    with pytest.raises(DialectError):
        db.execute("CREATE TABLE v (k INT)")
    assert Database(db.store).read("t").count() == 0
    before = db.store._last()[0]
    db.execute("COMMIT")
    assert db.store._last()[0] == before + 1  # both tables in one step
    assert rows(db.execute("SELECT k FROM t")) == [(1,), (2,)] and rows(db.execute("SELECT k FROM u")) == [(7,)]


def test_two_writers_conflict(db):
    db.execute("CREATE TABLE t (k INT)")
    other = Database(db.store)
    db.execute("BEGIN")
    db.execute("INSERT INTO t VALUES (1)")
    other.execute("INSERT INTO t VALUES (2)")
    with pytest.raises(ConflictError):
        db.execute("COMMIT")
    assert rows(other.execute("SELECT k FROM t")) == [(2,)]


def test_definitions_outlive_the_object(db, tmp_path):
    db.execute("CREATE TABLE p (id INT PRIMARY KEY, name TEXT)")
    db.execute("CREATE TABLE c (id INT, p INT REFERENCES p (id) ON DELETE CASCADE ON UPDATE CASCADE)")
    db.execute("INSERT INTO p VALUES (1, 'a'), (2, 'b')")
    db.execute("INSERT INTO c VALUES (10, 1), (11, 2)")
    db.execute("ALTER TABLE p ADD COLUMN size INT DEFAULT 3")
    db.execute("ALTER TABLE p ALTER COLUMN name SET NOT NULL")
    db.execute("ALTER TABLE p ADD CONSTRAINT small CHECK (size < 10)")
    db.execute("ALTER TABLE p RENAME COLUMN name TO label")
    db.execute("CREATE VIEW big AS SELECT id FROM p WHERE size > 2")
    db.execute("CREATE SEQUENCE s START WITH 5")
    db.execute("CREATE SCHEMA extra")
    db.execute("CREATE INDEX body ON p USING fulltext (label) WITH (k1 = 0, stop_words = false)")
    db.execute("CREATE FUNCTION twice(x INT) RETURNS INT IMMUTABLE AS 'x * 2'")
    db.execute("CREATE PROCEDURE rename_(i INT, t TEXT) AS 'UPDATE p SET label = t WHERE id = i RETURNING label'")
    db.execute("SET search_path = 'extra'")
    assert db.execute("SHOW search_path").first()[0] == "extra"
    again = Database(db.store)
    assert rows(again.execute("CALL rename_(2, 'z')")) == [("z",)]
    again.execute("UPDATE p SET id = 7 WHERE id = 1")
    assert rows(again.execute("SELECT p FROM c")) == [(2,), (7,)]
    again.execute("DELETE FROM p WHERE id = 2")
    assert rows(again.execute("SELECT id, p FROM c")) == [(10, 7)] and rows(again.execute("SELECT id, twice(size) AS d FROM p")) == [(7, 6)]
    assert again.nextval("s") == 5 and rows(again.execute("SELECT * FROM big")) == [(7,)] and again.search_options("p", "label")[1] == {"k1": 0.0}
    with pytest.raises(ConstraintError):
        again.execute("INSERT INTO p VALUES (8, 'q', 11)")
    with pytest.raises(ValueError, match="itself"):
        again.execute("CREATE FUNCTION f(x INT) RETURNS INT AS 'f(x)'")
    again.store.backup(f"file://{tmp_path}/copy")
    third = Store(db.spark, f"file://{tmp_path}/third")
    third.restore(f"file://{tmp_path}/copy")
    restored = Database(third)
    assert rows(restored.execute("SELECT id FROM big")) == [(7,)] and restored.tables["c"].foreign_keys[0].on_delete == "cascade"
    again.execute("DROP VIEW big")
    again.execute("DROP INDEX body")
    again.execute("DROP TABLE IF EXISTS nothing")
    assert "big" not in again.views and not Database(again.store).indexes


def test_rollups_and_retention_as_statements(db):
    db.execute("CREATE TABLE ev (tenant TEXT, event_at TIMESTAMP, amount INT)")
    db.execute("CREATE ROLLUP hourly ON ev USING time_bucket('1 hour', event_at) GROUP BY tenant AGGREGATES COUNT(*) AS total, SUM(amount) AS amount_sum")
    db.execute("INSERT INTO ev VALUES ('a', TIMESTAMP '2026-01-01 00:10:00', 1), ('a', TIMESTAMP '2026-01-01 00:50:00', 2), ('b', TIMESTAMP '2026-01-09 00:00:00', 3), ('b', NULL, 4)")
    got = db.store.read("rollup_hourly").collect()  # refreshed by the write
    assert sorted((r["tenant"], r["total"], r["amount_sum"]) for r in got) == [("a", 2, 3), ("b", 1, 3), ("b", 1, 4)]
    db.execute("CREATE RETENTION POLICY old ON ev USING event_at RETAIN FOR '7 days'")
    db.execute("CREATE RETENTION POLICY IF NOT EXISTS old ON ev USING event_at RETAIN FOR '1 day'")
    db.execute("ALTER RETENTION POLICY old RETAIN FOR '2 days'")
    assert tuple(db.execute("ENFORCE RETENTION POLICY old AT '2026-01-10T00:00:00Z'").first()) == (2, 1, 1)
    assert db.execute("SELECT * FROM ev").count() == 2
    db.execute("DROP RETENTION POLICY old")
    db.execute("DROP ROLLUP hourly")


def test_retention_skips_what_a_foreign_key_holds(db):
    db.execute("CREATE TABLE par (id INT PRIMARY KEY, event_at TIMESTAMP)")
    db.execute("CREATE TABLE chi (p INT REFERENCES par (id) ON DELETE RESTRICT)")
    db.execute("INSERT INTO par VALUES (1, TIMESTAMP '2020-01-01'), (2, TIMESTAMP '2020-01-01')")
    db.execute("INSERT INTO chi VALUES (1)")
    db.execute("CREATE RETENTION POLICY p ON par USING event_at RETAIN FOR '1 day'")
    assert tuple(db.execute("ENFORCE RETENTION POLICY p AT '2026-01-01'").first()) == (1, 0, 1)
    assert rows(db.execute("SELECT id FROM par")) == [(1,)]


def test_graphs_projections_copy_and_plans_as_statements(db, tmp_path):
    db.execute("CREATE GRAPH social (NODES (label TEXT), EDGES (source TEXT))")
    db.execute("INSERT INTO social_edges VALUES ('e', 'p', '1', 'p', '2', 'knows', 1.0, 'x')")
    assert rows(db.execute("SELECT node_id FROM graph_expand('social', 'p', '1', 2, 'out', 'knows', 8)")) == [("2",)]
    db.execute("CREATE TABLE t (k INT PRIMARY KEY, v TEXT)")
    (tmp_path / "in.csv").write_text("k,v\n1,a\n2,\\N\n3,c\n")
    db.execute(f"COPY t FROM 'file://{tmp_path}/in.csv'")
    assert rows(db.execute("SELECT k, v IS NULL FROM t")) == [(1, False), (2, True), (3, False)]
    db.execute("CREATE MATERIALIZED PROJECTION a WITH (partition_by = 'k') AS SELECT k, v FROM t")
    db.execute("CREATE MATERIALIZED PROJECTION b AS SELECT k, v FROM t WHERE k < 3")
    for mode in ("metadata_only", "hashes_only", "indexes_only", "full"):
        assert db.execute(f"VERIFY PROJECTION a MODE {mode}").first()["ok"]
    page = db.execute("DIFF PROJECTION a WITH b LIMIT 5").collect()
    assert [(r["row_id"], r["change"], r["complete"], r["next_cursor"]) for r in page] == [("3", "removed", True, None)]
    db.execute("DELETE FROM t WHERE k = 3")
    assert db.execute("REPAIR PROJECTION a SCOPE full_rebuild").first()["needed"]
    with pytest.raises(ValueError):
        db.execute("INSERT INTO a VALUES (5, 'x')")
    plan = "\n".join(r[0] for r in db.execute("EXPLAIN ANALYZE SELECT k FROM t WHERE k = 1").collect())
    assert "rows: 1" in plan and "PushedFilters" in plan


def test_translation_leaves_strings_alone():
    assert translate("SELECT 'a <-> $1 LIKE -- x' AS s, \"odd \"\"name\" FROM t") == "SELECT 'a <-> $1 LIKE -- x' AS s, `odd \"name` FROM t"
