"""The ingestion queries against DuckDB, and what they can't show: batches, rival writers, streams."""

import os
import re
from glob import glob

import duckdb
import literal_cases
import pytest

from tracewell.operators import upsert as U
from tracewell.operators.impact import Cache
from tracewell.plans import ingestion
from tracewell.plans.nlq import raw_query
from tracewell.sources.sql_lineage import extract
from tracewell.streaming import cdc


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in glob("/root/testdata/sf0.001/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


CASES = {n: v for n, v in ingestion.TABLE.items() if re.match("b0|b11|f|d0|l0|c0[123]|c04|c10_l|c17|e01|e06|e13", n)} | {f"literal {n}": v for n, v in literal_cases.TABLE.items()}


@pytest.mark.parametrize("name", CASES)
def test_matches_sql(spark, sf, tables, name):
    df = CASES[name][0](spark, sf)
    cols = sorted(df.columns)
    found = tables.execute(CASES[name][1])
    at = [[d[0] for d in found.description].index(c) for c in cols]
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=repr)


def event(spark, ident, sources, targets, derived, at):
    ref = lambda d, c: {"dataset": d, "column": c, "warehouse": "generic"}
    ds = [{"source": ref(*s), "target": ref(*t), "expression": None, "is_passthrough": True} for s, t in derived]
    return spark.createDataFrame([(ident, "sql", "p", None, at, f"t{ident}", "n", None, sources, targets, ds, None, None, False, "ok")], _schema())


def _schema():
    from tracewell.model import EVENT_SCHEMA

    return EVENT_SCHEMA


def test_columns_of_datasets_of_earlier_batches(spark):
    from datetime import datetime

    store = U.GraphStore(spark)
    store.apply(event(spark, "1", ["a"], ["b"], [], datetime(2024, 1, 1)), "first")
    store.apply(event(spark, "2", ["x"], ["y"], [(("a", "c"), ("y", "d"))], datetime(2024, 1, 2)), "second")
    got = store.edges().where("rel_type = 'PART_OF'").join(store.nodes().selectExpr("node_id as src", "dataset", "name"), "src")
    assert sorted((r["dataset"], r["name"]) for r in got.collect()) == [("a", "c"), ("y", "d")]


def test_a_rival_takes_the_version(spark, monkeypatch):
    """The second writer reads the versions before the first commits; its batch is not lost."""
    from datetime import datetime

    store, rival = U.GraphStore(spark), None
    rival = U.GraphStore(spark, store.root)
    seen, real = [], store._log

    def stale():
        now = real()
        if not seen:
            seen.append(1)
            rival.apply(event(spark, "1", ["a"], [], [], datetime(2024, 1, 1)), "rival")
        return now

    monkeypatch.setattr(store, "_log", stale)
    assert store.apply(event(spark, "2", ["b"], [], [], datetime(2024, 1, 2)), "own")
    assert store.versions() == [(1, "rival"), (2, "own")]
    assert {r["name"] for r in store.nodes().where("label = 'Dataset'").collect()} == {"a", "b"}
    assert not store.apply(event(spark, "2", ["b"], [], [], datetime(2024, 1, 2)), "own")


def test_drop_table_in_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"op": "c", "ts_ms": 1, "source": {"table": "t"}, "after": {"ddl": "DROP TABLE s.t; ALTER TABLE u DROP COLUMN c"}}\n')
    seen = []
    q = cdc.apply_changes(cdc.envelopes(spark, str(tmp_path / "in")), Cache(), seen.append, str(tmp_path / "check"))
    q.awaitTermination(60)
    assert [(c["change_type"], c["dataset"]) for b in seen for c in b] == [("drop_table", "s.t"), ("drop_column", "u")]


def test_the_callers_session_keeps_its_settings(spark):
    key = "spark.sql.ansi.doubleQuotedIdentifiers"
    before = spark.conf.get(key)
    extract(spark, 'SELECT "A" FROM t', "p", "o")
    assert spark.conf.get(key) == before and spark.sql("select \"x\" as a").first()[0] == "x"


REFUSED = [
    "select reflect('java.lang.System', 'getProperty', 'user.home')", "select * from text.`/etc/hostname`", "ADD FILE '/etc/hostname'", "SET spark.sql.ansi.enabled=false", "drop table v",
    "select * from v where a in (select value from text.`/etc/hostname`)", "insert into v select 1", "select * from elsewhere", "with v2 as (select * from other) select * from v2",
    "select * from v, lateral (select * from text.`/etc/hostname`)", "select identifier('reflect')('java.lang.System', 'getProperty', 'user.home') from v", "select identifier('ref' || 'lect')('java.lang.System', 'getProperty', 'user.home') from v",
    "select * from identifier('elsewhere')", "select try_reflect('java.lang.System', 'exit', 1) from v", "select java_method('a', 'b') from v", "select (select max(value) from text.`/etc/hostname`) from v", "select * from v join lateral (select value from text.`/etc/hostname`) on true",
    "select system.builtin.reflect('a', 'b') from v", "select * from range(5)", "select input_file_name() from v", "select a from v order by (select max(value) from text.`/x`)", "select sum(a) over (partition by reflect('a', 'b')) from v", "with w as (select * from w) select * from w",
    "select * from v lateral view reflect('a', 'b') t as x", "values (reflect('java.lang.System', 'getProperty', 'user.home'))", "select * from v tablesample (reflect('a', 'b') rows)", "select * from v where exists (select 1 from text.`/x`)", "explain select * from v", "select transform(a) using 'cat' from v",
]


@pytest.mark.parametrize("query", REFUSED)
def test_raw_queries_that_do_not_only_read(spark, query):
    with pytest.raises(PermissionError):
        raw_query(spark, query, v=spark.range(2))


def test_raw_queries(spark):
    v = spark.range(4).withColumnRenamed("id", "a")
    assert raw_query(spark, "with w as (select a from v where a > :low) select count(*) n, 'set' s from w;", {"low": 1}, v=v).first()[:] == (2, "set")
    assert raw_query(spark, "select a from v where a in (select max(a) from v) order by a limit 3", v=v).collect()[0][0] == 3
    ok = [
        "select * from (select a, a + 1 b from v) q join v on q.a = v.a and not q.b <=> 3 left join v w using (a) where q.a between 0 and 9 and q.b is not null or v.a in (1, 2)", "select a % 2 k, sum(a) s, count(distinct a) n from v group by a % 2 having sum(a) > 0 order by k desc nulls last",
        "select a, sum(a) over (partition by a % 2 order by a rows between 1 preceding and current row) r, max(a) over w from v window w as (order by a)", "select a from v union all select a from v except select 1", "select x.b from v, lateral (select v.a * 2 b) x", "with recursive r(n) as (select 0 union all select n + 1 from r where n < 3) select * from r",
        "select case when a = 1 then 'x' else upper('y') end c, cast(a as string) d, a::int e, array(1, 2)[0] f, -a g, transform(array(a), x -> x + 1) h, date '2020-01-01' i, if(a > 1, 1, 2) j from v", "select e from v lateral view explode(array(1, 2)) t as e", "select k, sum(a) from (select a, a % 2 k from v) group by cube(k)", "select * from values (1, 'a') as t(x, y)",
        "select extract(year from date '2020-01-01') y, trim('  x ') t, substring('abc', 2) u, 'a' || 'b' c, a like '1%' l, current_date() d, count(*) over () f, (select max(a) from v) m from v", "select exists (select 1 from v w where w.a = v.a) e, interval '1' day i, struct(a, 1) s, named_struct('x', a).x from v", "select distinct a from v limit 2 offset 1",
    ]
    for q in ok:
        assert raw_query(spark, q, v=v).collect(), q
    with pytest.raises(ValueError):
        raw_query(spark, "  ")
