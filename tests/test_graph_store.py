"""The store's deltas, bases and versions: what a batch writes, what a look-up reads, and that folding changes nothing."""

import os

import pytest
from pyspark.sql import functions as F

from tracewell.operators import upsert as U


def events(spark, first, last):
    ref = lambda d, c: F.struct(d.alias("dataset"), c.alias("column"), F.lit("generic").alias("warehouse"))
    k = F.col("id")
    name = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    rows = spark.range(first, last).select(
        name("e", k).alias("event_id"), F.lit("sql").alias("source_type"), F.lit("p").alias("project_name"), name("c", k % 5).alias("commit_id"), F.timestamp_seconds(k + 1_700_000_000).alias("ingested_at"), name("t", k % 4000).alias("transform_id"), name("n", k).alias("transform_name"),
        F.lit("line").alias("pipeline_name"), F.array(name("d", k % 5000)).alias("source_datasets"), F.array(name("o", k % 6000)).alias("target_datasets"), F.array(F.struct(ref(name("d", k % 5000), F.lit("x")).alias("source"), ref(name("o", k % 6000), F.lit("y")).alias("target"), name("f", k).alias("expression"), F.lit(False).alias("is_passthrough"))).alias("column_derivations"),
        name("select ", k).alias("raw_sql"), F.lit(None).cast("string").alias("tags"), F.lit(False).alias("llm_inferred"), F.lit("ok").alias("validation_status"),
    )
    return rows


def rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    s = U.GraphStore(spark, str(tmp_path_factory.mktemp("store")), fold_after=None, buckets=8)
    s.apply(events(spark, 0, 12_000), "large")
    s.compact()
    s.apply(events(spark, 11_990, 12_050), "small")
    s.apply(events(spark, 12_050, 12_060), "smaller")
    return s


def test_a_small_batch_writes_little(store):
    assert store.versions() == [(1, "large"), (3, "small"), (4, "smaller")]
    assert size(f"{store.root}/versions/v00000003") < 0.05 * size(f"{store.root}/versions/v00000001")
    assert sorted(os.listdir(f"{store.root}/versions")) == [f"v{n:08d}" for n in (1, 2, 3, 4)]


def test_reading_folds_bases_and_deltas(spark, store):
    whole = U.GraphStore(spark, fold_after=None)
    whole.apply(events(spark, 0, 12_000), "large")
    whole.apply(events(spark, 11_990, 12_050), "small")
    whole.apply(events(spark, 12_050, 12_060), "smaller")
    before = rows(store.nodes()), rows(store.edges())
    assert before == (rows(whole.nodes()), rows(whole.edges()))
    ev = U.prepared(events(spark, 0, 12_060))
    assert {(r[0], r[1], r[2]) for r in U.event_nodes(ev).select("node_id", "commit_id", "source_type").collect()} == {(r[0], r[1], r[2]) for r in store.nodes().select("node_id", "commit_id", "source_type").collect()}
    assert store.compact() and not store.compact()
    assert before == (rows(store.nodes()), rows(store.edges()))
    assert store.apply(events(spark, 50_000, 50_001), "more") and not store.apply(events(spark, 50_000, 50_001), "more") and not store.apply(events(spark, 0, 1), "small")
    assert store.versions()[-1] == (6, "more")


def test_earlier_versions_stay(spark, store):
    first = U.GraphStore(spark, fold_after=None)
    first.apply(events(spark, 0, 12_000), "large")
    for version in (1, 2):
        assert rows(store.nodes(version=version)) == rows(first.nodes()) and rows(store.edges(version=version)) == rows(first.edges())
    assert store.nodes(version=0).count() == 0


def _files(df):
    """Files that the scans of a run query read."""
    df.collect()
    total, plans = 0, [df._jdf.queryExecution().executedPlan()]
    while plans:
        p = plans.pop()
        if p.nodeName().startswith("AdaptiveSparkPlan"):
            plans.append(p.executedPlan())
            continue
        if p.nodeName().endswith("QueryStage"):
            plans.append(p.plan())
        if p.nodeName().startswith("Scan parquet") and p.metrics().contains("numFiles"):
            total += p.metrics().apply("numFiles").value()
        plans += [p.children().apply(i) for i in range(p.children().size())]
    return total


def test_a_name_reads_few_files(spark, store):
    named = store.nodes("Dataset", "d31", version=4)
    whole = store.nodes(version=4).where("label = 'Dataset' and name = 'd31'")
    assert rows(named) == rows(whole) and len(rows(named)) == 1
    every = store.nodes(version=4)
    assert _files(store.nodes("Dataset", "d31", version=2)) == 1 < _files(store.nodes("Dataset", version=2)) < _files(store.nodes(version=2))
    assert _files(named) < _files(store.nodes("Dataset", version=4)) < _files(every)
    src = store.edges(version=4).where("rel_type = 'READS_FROM'").first()["src"]
    assert rows(store.edges("READS_FROM", src, version=4)) == rows(store.edges(version=4).where(F.col("rel_type") == "READS_FROM").where(F.col("src") == src))


def test_it_folds_by_itself(spark):
    s = U.GraphStore(spark, fold_after=3, buckets=2)
    for k in range(7):
        s.apply(events(spark, k * 10, k * 10 + 12), f"b{k}")
    assert [b for _, b in s.versions()] == [f"b{k}" for k in range(7)] and sum(r["buckets"] > 0 for r in s._log()) >= 2
    assert s.nodes("Snapshot").count() == 7 * 12 - 6 * 2 and s.nodes("Dataset", "d71").count() == 1
