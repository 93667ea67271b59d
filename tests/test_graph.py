import json
from datetime import datetime

import pytest

from tracewell.model import EVENT_SCHEMA
from tracewell.operators import impact as I
from tracewell.operators import traverse as T
from tracewell.operators import upsert as U
from tracewell.plans import nlq


def event(n, sources, targets, derived=(), **more):
    ref = lambda d, c: {"dataset": d, "column": c, "warehouse": "generic"}
    ds = [{"source": ref(*s), "target": ref(*t), "expression": x, "is_passthrough": x is None} for s, t, x in derived]
    base = {"event_id": f"e{n}", "source_type": "sql", "project_name": "p", "commit_id": f"c{n}", "ingested_at": datetime(2024, 1, n), "transform_id": "t", "transform_name": "job", "pipeline_name": "pipe", "source_datasets": sources, "target_datasets": targets, "column_derivations": ds, "raw_sql": None, "tags": None, "llm_inferred": False, "validation_status": "ok"}
    return base | more


def frame(spark, *events):
    return spark.createDataFrame(list(events), EVENT_SCHEMA)


FIRST = dict(sources=["raw"], targets=["mart"], derived=[(("raw", "a"), ("mart", "b"), "cast(a as int)"), (("raw", "k"), ("mart", "k"), None)])


def counts(df, col):
    return {r[col]: r["count"] for r in df.groupBy(col).count().collect()}


def test_upsert_counts_and_last_writer(spark):
    ev = U.prepared(frame(spark, event(1, **FIRST), event(2, ["raw"], ["mart"], [(("raw", "a"), ("mart", "b"), None)], source_type="dbt", validation_status="flagged")))
    n, e = U.event_nodes(ev), U.event_edges(ev)
    assert counts(n, "label") == {"Dataset": 2, "Column": 4, "Transform": 1, "Pipeline": 1, "Snapshot": 2}
    assert counts(e, "rel_type") == {"READS_FROM": 2, "WRITES_TO": 2, "DERIVES_FROM": 2, "PART_OF": 5}
    d = {r["name"]: r for r in n.where("label = 'Dataset'").collect()}
    assert d["raw"]["source_type"] == "sql" and d["raw"]["commit_id"] == "c2" and d["raw"]["last_seen_at"] == datetime(2024, 1, 2)
    b = [r for r in e.where("rel_type = 'DERIVES_FROM' and last_seen_at is not null").collect()]
    assert len(b) == 1 and b[0]["expression"] is None and b[0]["is_passthrough"] is False


def test_empty_commit_is_event_id(spark):
    assert U.prepared(frame(spark, event(1, **FIRST, commit_id=""))).first()["commit"] == "e1"


def test_store_is_idempotent(spark, tmp_path):
    s = U.GraphStore(spark, str(tmp_path / "g"))
    assert s.apply(frame(spark, event(1, **FIRST)), "b1") and not s.apply(frame(spark, event(1, **FIRST)), "b1")
    before = (s.nodes().count(), s.edges().count())
    assert s.apply(frame(spark, event(1, **FIRST)), "b2")
    assert (s.nodes().count(), s.edges().count()) == before and len(s.versions()) == 2
    assert s.apply(frame(spark, event(3, ["mart"], ["top"], source_type="dbt")), "b3")
    mart = s.nodes().where("name = 'mart' and label = 'Dataset'").first()
    assert mart["source_type"] == "sql" and mart["commit_id"] == "c3"


def test_replay(spark):
    ev = frame(spark, event(1, **FIRST), event(2, ["x"], ["y"]))
    n, _ = U.replay(ev, commit="c2")
    assert {r["name"] for r in n.where("label = 'Dataset'").collect()} == {"x", "y"}
    assert U.replay(ev, until=datetime(2024, 1, 1))[0].where("label = 'Dataset'").count() == 2


def edges(spark, *pairs):
    return spark.createDataFrame([(a, b, "DERIVES_FROM") for a, b in pairs], "src string, dst string, rel_type string")


def starts(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "node_id string")


def test_bfs_cycles_loops_and_depth(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("c", "c"), ("c", "d"), ("d", "e"))
    got = {r["node_id"]: r["level"] for r in T.bfs(T.hops(e), starts(spark, "a"), 3).collect()}
    assert got == {"b": 1, "c": 2, "d": 3}
    assert T.bfs(T.hops(e), starts(spark)).count() == 0
    paths = {r["node_id"]: r["path"] for r in T.paths_from(T.hops(e), starts(spark, "a"), 4).collect()}
    assert paths["e"] == ["a", "b", "c", "d", "e"]


def test_longest_trail_walks_a_loop_once(spark):
    e = edges(spark, ("x", "y"), ("y", "y"), ("y", "z"))
    assert [r["chain"] for r in T.longest_trail(e, starts(spark, "z"), ["DERIVES_FROM"]).collect()] == [["x", "y", "y", "z"]]


def test_longest_trail_finds_out_about_cycles(spark, monkeypatch):
    walks, walk = [], T._walk
    monkeypatch.setattr(T, "_walk", lambda *a, **k: walks.append(k["least"]) or walk(*a, **k))
    through = T._walk_components
    monkeypatch.setattr(T, "_walk_components", lambda *a: walks.append("components") or through(*a))
    dense = [(f"{i}{a}", f"{i + 1}{b}") for i in range(4) for a in "xyz" for b in "xyz"]
    trail = lambda pairs, *ids, **k: sorted((r["start"], r["chain"]) for r in T.longest_trail(edges(spark, *pairs), starts(spark, *ids), ["DERIVES_FROM"], **k).collect())
    assert trail(dense + dense, "4y", "0x") == [("4y", ["0x", "1x", "2x", "3x", "4y"])] and walks == [True]
    # A walk that may take an edge again goes round the loop; the trail doesn't.
    assert trail([("a", "b"), ("b", "c"), ("c", "b"), ("b", "d")], "d") == [("d", ["a", "b", "c", "b", "d"])] and walks == [True, True, "components"]
    # Deeper than the depth: walked as before.
    long = [(f"{i:02}", f"{i + 1:02}") for i in range(12)]
    assert trail(long, "12") == trail(long, "12", acyclic=False) == []
    assert trail(long, "05") == [("05", [f"{i:02}" for i in range(6)])]


def test_reach_takes_repeated_edges(spark):
    e = edges(spark, *[("a", "b"), ("b", "c"), ("c", "a")] * 3)
    assert sorted(map(tuple, T.bfs(T.hops(e), starts(spark, "a", "a"), parents=True).collect())) == [("b", 1, "a"), ("c", 2, "b")]
    n = spark.createDataFrame([("a",), ("d",)], "node_id string")
    assert sorted(map(tuple, T.fan_out(n, e, ["DERIVES_FROM"]).collect())) == [("a", 1), ("d", 0)]


def test_scores(spark):
    rows = [(f, t, c) for f in (0, 1, 2, 3, 10, 500) for t, c in (("P2", "daily"), ("P0", "hourly"))]
    df = spark.createDataFrame(rows, "f int, t string, c string")
    import pyspark.sql.functions as F

    got = [r[0] for r in df.select(I.score(F.col("t"), F.col("c"), F.col("f"))).collect()]
    assert got == [0.25, 0.74, 0.2723, 0.7623, 0.2853, 0.7753, 0.2946, 0.7846, 0.3271, 0.8171, 0.45, 0.94]


def test_report_and_cache(spark):
    ev = U.prepared(frame(spark, event(1, **FIRST), event(2, ["mart"], ["top"], [(("mart", "b"), ("top", "z"), None)], transform_id="t2")))
    n, e = U.event_nodes(ev), U.event_edges(ev)
    now = [0.0]
    cache = I.Cache(900, lambda: now[0])
    change = I.SchemaChange("raw", "a", "drop_column")
    r = I.blast_radius(n, e, change, cache=cache)
    got = {(x["node_type"], x["name"]) for x in r["assets"].collect()}
    assert got == {("Column", "b"), ("Column", "z"), ("Dataset", "mart"), ("Dataset", "top"), ("Transform", "job"), ("Pipeline", "pipe")}
    assert r["report"]["summary"] == "Changing raw.a (drop_column) affects 7 downstream assets. 2 downstream datasets."
    assert cache.get(I.cache_key(change) + ":documented") is not None
    now[0] = 901
    assert cache.get(I.cache_key(change) + ":documented") is None
    assert I.cache_key(change) == I.cache_key(I.SchemaChange("raw", "a", "drop_column", "n"))


def test_unknown_tier_raises(spark):
    nodes = spark.createDataFrame([("d", "Dashboard", "d", None, "P9", None)], "node_id string, label string, name string, dataset string, sla_tier string, freshness_cadence string")
    reach = spark.createDataFrame([("d", 1)], "node_id string, fan_out long")
    with pytest.raises(Exception, match="P9"):
        I.ranked(nodes, reach, I.SchemaChange("x")).collect()


def test_validator(spark):
    assert nlq.validate("MATCH (d:Dataset) RETURN d.name") == []
    assert nlq.validate("MATCH (d:Dataset)-[:READS_FROM]->(t) RETURN count(DISTINCT d)") == []
    assert nlq.validate("MATCH (t:Table) RETURN t") == ["unknown label: Table"]
    assert "unknown relationship: NOPE" in nlq.validate("MATCH (a:Dataset)-[r:NOPE]->(b) RETURN a")
    assert nlq.validate("MATCH (d:Dataset) DELETE d") and nlq.validate("  ") == ["query is empty or too short"]
    assert nlq.validate("MATCH (t:Table) RETURN t", "as_implemented") == []
    assert nlq.validate("MATCH (d:Dataset) RETURN count(DISTINCT d)", "as_implemented") == ["unknown label: DISTINCT"]
    df = spark.createDataFrame([("MATCH (:Table) merge (y)",), ("",)], "query string")
    assert [len(r["validation_errors"]) for r in nlq.validated(df).collect()] == [2, 1]
    assert nlq.strip_fences("```cypher\nMATCH\n```") == "MATCH"


def test_pattern_and_questions(spark):
    ev = U.prepared(frame(spark, event(1, **FIRST), event(2, ["mart"], ["top"], transform_id="t2", project_name="p")))
    n, e = U.event_nodes(ev), U.event_edges(ev)
    got = nlq.pattern("MATCH (t:Transform)-[:READS_FROM]->(d:Dataset {name: 'raw'}) RETURN t.name AS job, count(DISTINCT d) AS n", n, e).collect()
    assert [tuple(r) for r in got] == [("job", 1)]
    far = nlq.pattern("MATCH (a:Column {dataset: 'mart'})-[:DERIVES_FROM*1..2]->(b:Column) WHERE b.dataset = 'raw' RETURN DISTINCT b.name AS name ORDER BY name LIMIT 5", n, e).collect()
    assert [r["name"] for r in far] == ["a", "k"]
    with pytest.raises(ValueError):
        nlq.pattern("MATCH (d:Dataset) SET d.x = 1 RETURN d.name", n, e)
    assert {r["name"] for r in nlq.ask("What columns does mart expose?", n, e)["rows"].collect()} == {"b", "k"}
    assert not nlq.ask("Sing a song", n, e)["validated"]
    rep = nlq.evaluate([{"question": "Which transforms read from more than one source dataset?", "expected_result_contains": [], "expected_min_results": 0}, {"question": "Count how many transforms are in each project", "expected_result_contains": ["p"], "expected_min_results": 1}], n, e)
    assert rep["accuracy"] == 1.0
    for q in nlq.SUGGESTIONS:
        assert nlq.translate(q, n, e) is not None, q
    with pytest.raises(PermissionError):
        nlq.raw_query(spark, "drop table x")
    assert nlq.raw_query(spark, "select name from nodes where label = :l", {"l": "Pipeline"}, nodes=n).count() == 1


def test_evaluation_files(spark, tmp_path):
    asked = [{"id": 1, "question": "List all P0 dashboards", "expected_result_contains": ["north"], "expected_min_results": 1}, {"question": "what else?", "expected_result_contains": None}]
    (tmp_path / "q.json").write_text(json.dumps(asked, indent=1))
    read = nlq.questions(spark, str(tmp_path / "q.json"))
    assert read[0] == {k: asked[0][k] for k in read[0]} and read[1] == {"question": "what else?", "expected_result_contains": [], "expected_min_results": 0}
    found = lambda q, n, e: spark.createDataFrame([("North sales",)], "name string") if "P0" in q else None
    result = nlq.evaluate(read, None, None, translator=found)
    for _ in range(2):
        nlq.save_evaluation(spark, result, str(tmp_path / "r"))
    row = spark.read.json(str(tmp_path / "r")).collect()
    assert len(row) == 1 and (row[0]["accuracy"], row[0]["passed"], row[0]["total"]) == (0.5, 1, 2) and [r["passed"] for r in row[0]["results"]] == [True, False]


def test_streams(spark, tmp_path):
    from tracewell.streaming import cdc

    src = tmp_path / "in"
    src.mkdir()
    rows = [{"op": "c", "ts_ms": 1, "source": {"table": "orders"}, "after": {"ddl": "ALTER TABLE a.b DROP COLUMN c", "dataset": "a.b"}}, {"op": "d", "ts_ms": 2, "source": {"table": "gone"}, "after": None}]
    (src / "1.json").write_text("\n".join(json.dumps(r) for r in rows))
    cache, seen = I.Cache(), []
    cache.put("x", 1)
    cdc.apply_changes(cdc.envelopes(spark, str(src)), cache, seen.extend, str(tmp_path / "ck")).awaitTermination()
    assert not cache.held and [s["change_type"] for s in seen] == ["drop_column"]
    batch = spark.createDataFrame([json.dumps(r) for r in rows], "string").selectExpr(f"from_json(value, '{cdc.ENVELOPE}') e").select("e.*")
    assert [r["dataset"] for r in cdc.routed(batch).orderBy("at").collect()] == ["a.b", "gone"]
    frame(spark, event(1, **FIRST)).write.parquet(str(tmp_path / "ev"))
    store = U.GraphStore(spark, str(tmp_path / "g2"))
    for _ in range(2):
        stream = spark.readStream.schema(EVENT_SCHEMA).parquet(str(tmp_path / "ev"))
        cdc.ingest_events(stream, store, str(tmp_path / "ck2")).awaitTermination()
    assert len(store.versions()) == 1 and store.nodes().count() == 9
    jobs = cdc.Jobs(1)
    assert jobs.run("a", lambda: 1 / 0) == "FAILURE" and jobs.status("b") == {"status": "PENDING"}
    assert cdc.with_inference([], lambda: None, ["s"])[0]["validation_status"] == "pending_review"
    assert cdc.ready(spark)


def _trails(pairs, start, depth):
    """All trails from a start, by depth-first search."""
    out, stack = [], [(start, (start,), frozenset())]
    while stack:
        node, chain, used = stack.pop()
        for a, b in pairs:
            if a == node and (a, b) not in used and len(chain) <= depth:
                out.append((b, *chain))
                stack.append((b, (b, *chain), used | {(a, b)}))
    return out


def test_trails_through_cycles_equal_a_search(spark):
    ring = [("a", "b"), ("b", "c"), ("c", "a"), ("b", "d"), ("d", "e"), ("e", "d"), ("e", "f"), ("d", "d"), ("a", "g"), ("g", "h"), ("c", "h"), ("h", "i"), ("x", "y"), ("y", "x")]
    for depth in (3, 6, 8):
        got = {r["start"]: tuple(r["chain"]) for r in T.longest_trail(edges(spark, *ring), starts(spark, "a", "d", "i", "x"), ["DERIVES_FROM"], depth, direction="out").collect()}
        sources = {a for a, _ in ring}
        want = {}
        for start in "adix":
            ends = [t for t in _trails(sorted(set(ring)), start, depth) if t[0] not in sources]
            if ends:
                want[start] = min(ends, key=lambda t: (-len(t), t))
        assert got == want


def test_components_of_cycles(spark):
    ring = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("f", "f"), ("e", "g"), ("g", "h"), ("a", "b"), ("z", "a")]
    got = {}
    for r in T.cyclic_components(T.hops(edges(spark, *ring))).collect():
        got.setdefault(r["component"], set()).add(r["node_id"])
    assert sorted(map(sorted, got.values())) == [["a", "b", "c"], ["d", "e"], ["f"]]
    assert T.cyclic_components(T.hops(edges(spark, ("a", "b"), ("b", "c")))).count() == 0


@pytest.mark.parametrize("name", ["{0:02}-{1}", "{2:02}-{1}"])
def test_components_of_a_chain_of_cycles_are_found_in_few_rounds(spark, monkeypatch, name):
    # Twelve cycles of three, each leading to the next, named in the order of the chain and against it.
    of = lambda i, k: name.format(i, k % 3, 99 - i)
    ring = [(of(i, k), of(i, k + 1)) for i in range(12) for k in range(3)] + [(of(i, 0), of(i + 1, 0)) for i in range(11)]
    tables = []
    for write in ("materialize", "counted"):
        monkeypatch.setattr(T, write, lambda df, to, *a, own=getattr(T, write): tables.append(to) or own(df, to, *a))
    got = {}
    for r in T.cyclic_components(T.hops(edges(spark, *ring))).collect():
        got.setdefault(r["component"], set()).add(r["node_id"])
    assert sorted(map(sorted, got.values())) == sorted(sorted(of(i, k) for k in range(3)) for i in range(12))
    assert len(tables) <= 60, tables


def test_walks_through_components_read_only_pairs_that_are_reached(spark, monkeypatch):
    read, through = [], T._walk_components
    monkeypatch.setattr(T, "_walk_components", lambda near, *a: read.append(sorted(map(tuple, near.collect()))) or through(near, *a))
    ring = [("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("x", "y"), ("y", "x")]
    got = T.longest_trail(edges(spark, *ring, *ring[:2]), starts(spark, "a"), ["DERIVES_FROM"], direction="out").collect()
    assert [tuple(r["chain"]) for r in got] == [("d", "c", "b", "a")]
    assert read == [[("a", "b"), ("b", "c"), ("c", "b"), ("c", "d")]]


def test_the_nearest_nodes_end_the_search_at_their_level(spark, monkeypatch):
    pairs = T.hops(edges(spark, ("a", "b"), ("a", "c"), ("b", "d"), ("c", "e"), ("d", "f"), ("f", "g"), ("g", "a")))
    some = spark.createDataFrame([("c",), ("d",), ("g",), ("z",)], "node_id string")
    levels = []
    monkeypatch.setattr(T, "counted", lambda df, name, own=T.counted: levels.append(name) or own(df, name))
    near = lambda **k: (levels.clear(), {tuple(r) for r in T.bfs(pairs, starts(spark, "a"), **k).collect()}, len(levels))[1:]
    one, two = {("b", 1), ("c", 1)}, {("d", 2), ("e", 2)}
    assert near(nearest=1) == (one, 1) and near(nearest=1, of=some) == (one, 1)
    assert near(nearest=3) == (one | two, 2) and near(nearest=2, of=some) == (one | two, 2)
    every = one | two | {("f", 3), ("g", 4)}
    assert near(nearest=9, of=some) == (every, 5) and near() == (every, 5)
