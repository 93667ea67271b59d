"""Many changes at once against one at a time, and the odd graphs."""

import pytest
from pyspark.sql import functions as F

from tracewell.operators import impact, many
from tracewell.operators.traverse import bfs, hops
from tracewell.plans.bridge import graph
from tracewell.runtime import materialize


def edges(spark, *pairs):
    return spark.createDataFrame([(a, b, "DERIVES_FROM") for a, b in pairs], "src string, dst string, rel_type string")


def test_bits_equal_single_searches(spark):
    ring = [(f"n{i}", f"n{(i + 1) % 90}") for i in range(90)] + [("n3", "n3"), ("n5", "x"), ("x", "y"), ("n5", "n50"), ("n5", "n50")]
    pairs = hops(edges(spark, *ring))
    starts = many.numbered(spark.createDataFrame([(f"n{i}",) for i in range(0, 90)] + [("y",), ("gone",), (None,), ("n1",)], "node_id string").repartition(3))
    got = many.many_bfs(pairs, starts.select("word", "node_id", F.col("bit").alias("bits")), depth=5)
    rows = got.join(starts.withColumnRenamed("node_id", "start"), "word").where("(bits & bit) <> 0").select("start", "node_id").collect()
    assert len(rows) == len({(r[0], r[1]) for r in rows}) + sum(r[0] == "n1" for r in rows) // 2  # n1 stands twice
    for start in ("n1", "n4", "n88", "y", "gone"):
        one = spark.createDataFrame([(start,)], "node_id string")
        assert {r["node_id"] for r in rows if r["start"] == start} == {r["node_id"] for r in bfs(pairs, one, 5).collect()}
    assert many.many_bfs(pairs, starts.select("word", "node_id", F.col("bit").alias("bits")).limit(0)).count() == 0


def test_reports_equal_single_reports(spark, sf):
    nodes, e = (materialize(x, "graph") for x in graph(spark, sf))
    for label, names in (("Column", ["k:1", "k:5", "k:199"]), ("Dataset", ["p:5", "c:3"])):
        changes = nodes.where((F.col("label") == label) & F.col("name").isin(*names)).select("node_id", "dataset", "name")
        got = {r["name"]: r for r in many.reports(nodes, e, changes, column=label == "Column").collect()}
        for name in names:
            change = impact.SchemaChange(got[name]["dataset"] or name, name if label == "Column" else None)
            starts = impact.starts_of(nodes, change)
            assets = impact.ranked(nodes, impact.affected(nodes, e, starts, column=label == "Column"), change, label == "Column", kept=None)
            want = impact.counts(assets, change).first()
            assert {k: got[name][k] for k in ("total", "p0_count", "p1_count", "dashboards", "features", "datasets")} == {k: want[k] for k in ("total", "p0_count", "p1_count", "dashboards", "features", "datasets")}
            assert got[name]["top_score"] == assets.agg(F.max("criticality_score")).first()[0]


def test_changes_that_reach_nothing(spark, sf):
    nodes, e = graph(spark, sf)
    rows = many.reports(nodes, e, spark.createDataFrame([("nowhere", "a"), ("nowhere", "b"), (None, "c")], "node_id string, word2 string")).collect()
    assert sorted((r["word2"], r["total"], r["top_score"]) for r in rows) == [("a", 0, None), ("b", 0, None), ("c", 0, None)]


def tangled(spark):
    """Columns in rings and chains, a start that is its own consumer's source, a feature reached in two ways, hubs."""
    n, e = [], []
    for i in range(70):
        n.append((f"k{i}", "Column", f"d{i % 9}", f"k{i}", None, None, None))
        e.append((f"k{i}", f"d{i % 9}", "PART_OF", None))
    n += [(f"d{i}", "Dataset", None, f"d{i}", None, None, None) for i in range(9)]
    n += [(f"t{i}", "Transform", None, f"t{i}", f"t{i}", None, None) for i in range(12)]
    n += [(f"s{i}", "Dashboard", None, f"s{i}", None, ("P0", "P1", "P2")[i % 3], "daily") for i in range(5)] + [("f", "MLFeature", None, "f", None, "P1", "weekly"), ("l", "Pipeline", None, "l", None, None, None)]
    e += [(f"k{i}", f"k{i // 2}", "DERIVES_FROM", f"t{i % 12}") for i in range(1, 60)] + [("k60", "k61", "DERIVES_FROM", "t1"), ("k61", "k62", "DERIVES_FROM", "t2"), ("k62", "k60", "DERIVES_FROM", None), ("k63", "k63", "DERIVES_FROM", "t3"), ("f", "k5", "DERIVES_FROM", "t4"), ("f", "k5", "DERIVES_FROM", "t4")]
    e += [(f"t{i}", f"d{i % 8}", "READS_FROM", None) for i in range(12)] + [("s0", f"d{i}", "READS_FROM", None) for i in range(9)] + [(f"s{i}", "d2", "READS_FROM", None) for i in range(1, 5)] + [("d3", "f", "PRODUCES", None)]
    e += [(f"t{i}", "l", "PART_OF", None) for i in range(12)]
    return (spark.createDataFrame(n, "node_id string, label string, dataset string, name string, transform_id string, sla_tier string, freshness_cadence string"), spark.createDataFrame(e, "src string, dst string, rel_type string, transform_id string"), n, e)


@pytest.mark.parametrize("limits", [{}, {"_LIST": 2, "_MEET": 3, "_A_TASK": 50}])
def test_lists_of_changes_meet_at_assets_whatever_their_limits(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(many, name, value)
    nodes, e, n, pairs = tangled(spark)
    label = {r[0]: r[1] for r in n}
    feeds, part, runs, reads, uses = ({} for _ in range(5))
    for src, dst, kind, by in pairs:
        if kind == "DERIVES_FROM" and src != dst:
            feeds.setdefault(dst, set()).add(src)
        if kind == "DERIVES_FROM" and by:
            uses.setdefault(dst, set()).add(by)
        if kind == "PART_OF":
            (part if label[src] == "Column" else runs).setdefault(src, set()).add(dst)
        if kind in ("READS_FROM", "PRODUCES"):
            a, b = (dst, src) if kind == "READS_FROM" else (src, dst)
            reads.setdefault(a, set()).add(b)
    walk = lambda at, of: {y for x in at for y in of.get(x, ())}
    want = {}
    for start in (k for k in label if label[k] == "Column"):
        cols, last = set(), {start}
        for _ in range(8):
            last = walk(last, feeds) - cols - {start}
            cols |= last
        sets = walk(cols, part)
        users = walk(cols | {start}, uses) | walk(sets, reads)
        got = (cols | sets | users | walk(users, runs)) - {start}
        want[start] = (len(got), *(sum(label[x] == kind for x in got) for kind in ("Dashboard", "MLFeature", "Dataset")))
    changes = spark.createDataFrame([(k, 1) for k in want] + [("k1", 2), (None, 3), ("gone", 4)], "node_id string, which int")
    rows = many.reports(nodes, e, changes).collect()
    assert len(rows) == len(want) + 3 and sum(r["total"] for r in rows if r["node_id"] in (None, "gone")) == 0
    assert {r["node_id"]: (r["total"], r["dashboards"], r["features"], r["datasets"]) for r in rows if r["node_id"] in want} == want


def test_a_nodes_changes_travel_in_bounded_lists(spark, monkeypatch):
    monkeypatch.setattr(many, "_LIST", 10)
    cols = spark.range(500).selectExpr("id as word", "'hub' as node_id", "5L as bits").unionAll(spark.sql("select 7L, 'one', shiftleft(1L, 63)"))
    rows = many._lists(cols).collect()
    hub = [r["numbers"] for r in rows if r["node_id"] == "hub"]
    assert sorted(x for xs in hub for x in xs) == sorted(w * 64 + i for w in range(500) for i in (0, 2)) and max(map(len, hub)) <= 20
    assert [r["numbers"] for r in rows if r["node_id"] == "one"] == [[7 * 64 + 63]]
