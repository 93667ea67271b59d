"""Lineage of tables of texts and plans: against the walker of single texts, real plans, and odd rows."""

import json

import pytest
from pyspark.sql import functions as F

from tracewell.sources import plan_tables, sql_lineage, sql_tables

#: Texts that both ways read alike.
ALIKE = [
    "SELECT a FROM s.t; SELECT b AS c FROM u -- ; not here\n;",
    "WITH a AS (SELECT k, v * 2 AS w FROM s.base), b AS (SELECT k, w FROM a) SELECT b.w, b.k FROM b",
    "WITH a AS (SELECT x FROM s.t) INSERT INTO w.o SELECT x FROM a",
    "CREATE TABLE w.n AS SELECT x + y AS z FROM t",
    "CREATE OR REPLACE VIEW v AS WITH z AS (SELECT a FROM t) SELECT z.a AS aa FROM z",
    "SELECT a FROM t WHERE a IN (SELECT b FROM u) AND EXISTS (SELECT 1 FROM s.v WHERE v.k = t.k)",
    'SELECT q."A", "B" FROM "S"."T" q',
    "SELECT l.a, r.b * l.c AS d FROM s.l l LEFT JOIN s.r r ON l.k = r.k",
    "SELECT u.* FROM t JOIN u ON t.k = u.k",
    "SELECT sum(v) OVER (PARTITION BY g ORDER BY d) AS s, (SELECT max(m) FROM u) AS top FROM t",
    "SELECT 1 AS one, current_date() AS today, count(*) AS n, a FROM t GROUP BY a",
    "SELECT a, b FROM t UNION ALL SELECT c, b FROM u",
    "(SELECT a FROM t) UNION (SELECT b FROM u)",
    "SELECT d.x, d.n FROM (SELECT x, count(y) AS n FROM t GROUP BY x) d",
    "SELECT * FROM (SELECT a, b + 1 AS c FROM t) q JOIN u ON q.a = u.a",
    "SELECT a FROM (t JOIN u ON t.k = u.k)",
    "SELECT t.a, (SELECT max(u.b) FROM u WHERE u.k = t.k) AS m FROM t",
    "WITH a AS (SELECT 1 AS x, k FROM t) SELECT a.k FROM a WHERE a.x IN (SELECT z FROM w)",
    "MERGE INTO t USING s ON t.k = s.k WHEN MATCHED THEN UPDATE SET t.v = s.v; ALTER TABLE t DROP COLUMN x",
    "SELECT first, a AS last FROM t ORDER BY a NULLS FIRST",
]
#: Texts that only the tables read right: (target, column, dataset, source, passed through).
OWN = {
    "SELECT x.a FROM t, LATERAL (SELECT a FROM u WHERE u.k = t.k) x": {(None, "a", "u", "a", True)},
    "SELECT y.e, e AS f FROM t LATERAL VIEW OUTER explode(t.xs) y AS e": {(None, "e", "t", "xs", False), (None, "f", "t", "xs", False)},
    "WITH RECURSIVE r AS (SELECT id, boss FROM emp UNION ALL SELECT e.id, r.boss FROM emp e JOIN r ON e.boss = r.id) SELECT id, boss FROM r": {(None, "id", "emp", "id", True), (None, "boss", "emp", "boss", True)},
    "SELECT q.z FROM (SELECT * FROM t) q": {(None, "z", "t", "z", True)},
    "INSERT INTO o (p, q) SELECT a, b FROM t": {("o", "p", "t", "a", True), ("o", "q", "t", "b", True)},
    "SELECT TOP 5 a, b FROM t": {(None, "a", "t", "a", True), (None, "b", "t", "b", True)},
    "SELECT a.b.c FROM t a": {(None, "c", "t", "b", True)},
    "WITH c(p, q) AS (SELECT a, b FROM t) SELECT p, q AS r FROM c x": {(None, "p", "t", "a", True), (None, "r", "t", "b", True)},
    "WITH t AS (SELECT a FROM t) SELECT a FROM t": {(None, "a", "t", "a", True)},
    "SELECT a FROM t QUALIFY row_number() OVER (ORDER BY b) = 1": {(None, "a", "t", "a", True)},
    "SELECT nosuch.a, b FROM t, u": {(None, "a", "nosuch", "a", True), (None, "b", "unknown", "b", True)},
    "SELEC a FROM t": set(),
    "SELECT a FROM": {(None, "a", "unknown", "a", True)},
    "select ) from ( t": set(),
    "'unclosed": set(),
    ";;": set(),
    "": set(),
}
CHAIN = "WITH c0 AS (SELECT a AS c FROM t)" + "".join(f", c{i} AS (SELECT * FROM c{i - 1})" for i in range(1, 12)) + " SELECT c FROM c11"


@pytest.fixture(scope="module")
def run(spark):
    texts = [*ALIKE, *OWN, None, CHAIN, "SELECT " + ", ".join(f"c{i}" for i in range(800)) + " FROM wide"]
    df = spark.createDataFrame(list(enumerate(texts)), "statement_id long, sql string").withColumn("n", F.lit("x")).withColumn("g", F.lit(1))
    made = sql_tables.Extraction(df)
    found, tables = {}, {}
    for r in made.derivations().collect():
        found.setdefault(texts[r["id"]], set()).add((r["target"], r["column"], r["source_dataset"], r["source_column"], r["is_passthrough"]))
    for r in made.sources.collect():
        tables.setdefault(texts[r["id"]], set()).add(r["dataset"])
    return found, tables


@pytest.mark.parametrize("text", ALIKE)
def test_equals_the_walker(spark, run, text):
    events = sql_lineage.extract(spark, text, "p")
    target = lambda e: None if e["target_datasets"][0] == "unknown" else e["target_datasets"][0]
    assert run[0].get(text, set()) == {(target(e), d["target"]["column"], d["source"]["dataset"], d["source"]["column"], d["is_passthrough"]) for e in events for d in e["column_derivations"]}
    assert run[1].get(text, set()) == {s for e in events for s in e["source_datasets"]}


@pytest.mark.parametrize("text", OWN)
def test_reads_what_the_walker_does_not(run, text):
    assert run[0].get(text, set()) == OWN[text]


def test_long_chains_and_wide_items(run):
    assert run[0][CHAIN] == {(None, "c", "t", "a", True)}
    assert len(next(v for k, v in run[0].items() if k and k.startswith("SELECT c0,"))) == 800


def test_catalogue_resolves_bare_names_and_stars(spark):
    texts = spark.createDataFrame([(1, "SELECT x, y, z FROM t, s.u"), (2, "SELECT * EXCEPT (y) FROM s.u"), (3, "SELECT q.X FROM (SELECT * FROM S.U) q")], "statement_id int, sql string")
    catalog = spark.createDataFrame([("t", 0, "x"), ("s.u", 0, "x2"), ("s.u", 1, "y"), ("s.u", 2, "x")], "dataset string, place int, column string")
    got = {(r["id"], r["column"], r["source_dataset"], r["source_column"]) for r in sql_tables.extract(texts, catalog=catalog).collect()}
    assert got == {(1, "x", "t", "x"), (1, "y", "s.u", "y"), (2, "x2", "s.u", "x2"), (2, "x", "s.u", "x"), (3, "X", "S.U", "x")} | {(1, "z", "unknown", "z")}


def test_no_texts(spark):
    assert sql_tables.extract(spark.createDataFrame([], "statement_id long, sql string")).count() == 0
    assert sql_tables.schema_changes(spark.createDataFrame([(1, None), (2, ""), (3, "ALTER TABLE t SET TBLPROPERTIES (a = b)")], "statement_id long, sql string")).count() == 0


def test_real_plans(spark, tmp_path):
    for name, column in (("left", "v"), ("right", "w")):
        spark.range(3).selectExpr("id as k", f"id * 2 as {column}").write.option("path", str(tmp_path / name)).mode("overwrite").saveAsTable(f"plan_{name}")
    q = spark.sql("select a.k, a.v + b.w as s, rank() over (partition by a.k order by b.w) as r from plan_left a join plan_right b on a.k = b.k union all select k, w * 2, 1 from plan_right")
    plan = json.loads(q._jdf.queryExecution().analyzed().toJSON())
    write = {"class": "org.apache.spark.sql.execution.datasources.InsertIntoHadoopFsRelationCommand", "num-children": 1, "outputPath": "/lake/out"}
    rows = [("real", json.dumps([write, *plan])), ("none", None), ("bad", "[{"), ("empty", "[]"), ("no write", json.dumps(plan)), ("odd", json.dumps([{"class": "AppendData", "num-children": 5}])), ("object", "{}")]
    df = spark.createDataFrame([(*r, "j") for r in rows], "plan_id string, plan string, job_id string")
    got = {(r["plan_id"], r["column"], r["source_dataset"], r["source_column"], r["is_passthrough"]) for r in plan_tables.derivations(df).collect()}
    left, right = "default.plan_left", "default.plan_right"
    assert got == {("real", "k", left, "k", True), ("real", "k", right, "k", True), ("real", "s", left, "v", False), ("real", "s", right, "w", False), ("real", "r", left, "k", False), ("real", "r", right, "w", False)}
    assert [(r["plan_id"], r["transform_id"], r["source_datasets"]) for r in plan_tables.events(df).orderBy("plan_id").collect()] == [("real", "j_out", [left, right])]
    assert plan_tables.derivations(df.limit(0)).count() == 0
    for name in ("left", "right"):
        spark.sql(f"drop table plan_{name}")
