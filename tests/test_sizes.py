"""Tasks, joins and files grow with the rows: what the queries at larger tables need."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from tracewell import runtime
from tracewell.plans import plan_queries, sql_queries
from tracewell.sources import plan_tables, sql_tables

_LIMIT, _MEASURED, _TASKS = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions"


def _oracle(sql: str, sf: str):
    con = duckdb.connect()
    for t in ("part", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return sorted(map(repr, con.execute(sql).fetchall()))


def test_a_files_rows_are_dealt_to_more_tasks_the_more_there_are(spark, sf, monkeypatch):
    for queries, made in ((plan_queries, plan_queries.plans), (sql_queries, sql_queries.texts)):
        assert made(spark, sf).rdd.getNumPartitions() == 1
        monkeypatch.setattr(queries, "_A_TASK", 20)
        assert made(spark, sf).rdd.getNumPartitions() >= 10


def test_a_plan_is_parsed_once(spark):
    plans = spark.createDataFrame([(1, "[]")], "plan_id long, plan string")
    text = plan_tables.nodes(plans)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Project [plan_id") and "Filter (size(from_json" not in text


def test_kinds_are_the_last_parts_of_classes_without_patterns(spark):
    kinds = [("a.b.Project", "Project"), ("Project", "Project"), ("", ""), ("a.", ""), (".", ""), ("a..B", "B"), (None, None)]
    df = spark.createDataFrame(kinds, "c string, want string").withColumn("got", F.expr(plan_tables._kind("c")))
    assert all(r["got"] == r["want"] for r in df.collect())
    plans = spark.createDataFrame([(1, "[]")], "plan_id long, plan string")
    assert "[.]" not in plan_tables.nodes(plans)._jdf.queryExecution().optimizedPlan().toString()


def test_nodes_without_columns_are_the_same_nodes(spark, sf):
    odd = [(-1, None), (-2, ""), (-3, "{"), (-4, "[]"), (-5, "{}"), (-6, "no json"), (-7, json.dumps([{"class": "a.LogicalRelation", "num-children": 0, "output": "odd"}]))]
    plans = plan_queries.plans(spark, sf).select("plan_id", "plan").union(spark.createDataFrame(odd, "plan_id long, plan string"))
    full, slim = plan_tables.nodes(plans), plan_tables.nodes(plans, columns=False)
    assert not {"output", "items"} & set(slim.columns)
    full = full.select(slim.columns)
    assert full.exceptAll(slim).isEmpty() and slim.exceptAll(full).isEmpty()
    assert slim.where("plan_id in (-1, -2, -4)").isEmpty()


@pytest.mark.parametrize("fail", [False, True])
def test_joins_within_go_by_what_is_shuffled_and_settings_come_back(spark, fail):
    before, limit = {k: spark.conf.get(k, None) for k in (_LIMIT, _MEASURED, _TASKS)}, spark.conf.get(_LIMIT)
    try:
        with runtime.by_shuffled_size(spark, 9):
            assert (spark.conf.get(_LIMIT), spark.conf.get(_MEASURED), spark.conf.get(_TASKS)) == ("-1", limit, "9")
            if fail:
                raise KeyError
    except KeyError:
        pass
    assert {k: spark.conf.get(k, None) for k in before} == before


def test_files_of_like_texts_are_not_broadcast(spark, tmp_path):
    # 300,000 rows of one long text are some kilobytes of files, but many megabytes of rows.
    spark.range(300000).select("id", F.lit("x" * 200).alias("text")).write.parquet(f"{tmp_path}/t")
    t = spark.read.parquet(f"{tmp_path}/t")

    def broadcast():
        j = t.join(t.select("id", F.upper("text").alias("other")), "id")
        j.write.format("noop").mode("overwrite").save()
        return "BroadcastHashJoin" in j._jdf.queryExecution().executedPlan().toString()

    assert broadcast()
    with runtime.by_shuffled_size(spark):
        assert not broadcast()


@pytest.mark.parametrize("query", ["c14_columns_without_source", "c15_given_sources", "c16_events", "c08_sql_lineage"])
def test_texts_in_many_tasks_match_sql(spark, sf, query, monkeypatch):
    monkeypatch.setattr(sql_queries, "_A_TASK", 50)
    monkeypatch.setattr(sql_tables, "_A_TASK", 1500)
    made, sql = sql_queries.TABLE[query]
    assert sorted(repr(tuple(r)) for r in made(spark, sf).collect()) == _oracle(sql, sf)


@pytest.mark.parametrize("query", ["e02_topmost_writes", "e04_relations", "e13_plan_events", "e06_plan_lineage", "e06_plan_lineage_as_implemented"])
def test_plans_in_many_tasks_match_sql(spark, sf, query, monkeypatch):
    monkeypatch.setattr(plan_queries, "_A_TASK", 300)
    made, sql = plan_queries.TABLE[query]
    assert sorted(repr(tuple(r)) for r in made(spark, sf).collect()) == _oracle(sql, sf)


def test_a_runs_tables_are_written_when_they_are_asked_for(spark, sf, monkeypatch):
    names, write = [], sql_tables.materialize
    monkeypatch.setattr(sql_tables, "materialize", lambda df, name, by=None: names.append(name) or write(df, name, by))
    run = sql_queries._run(spark, sf)
    assert run.sources.count() == run.sources.count() and names == ["sql-statements", "sql-groups", "sql-relations"]
    assert run.without_source().count() and names[3:] == ["sql-items", "sql-references", "sql-without-source"]
