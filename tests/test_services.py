"""Sources and services around the graph: brokers, databases, seeds, registries, answers, jobs."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from tracewell.operators import catalog as C
from tracewell.operators import impact as I
from tracewell.operators import upsert as U
from tracewell.plans import nlq
from tracewell.sources import registry, relational, seed
from tracewell.streaming import cdc


def test_messages_of_listed_tables(spark):
    said = lambda table: json.dumps({"op": "c", "ts_ms": 1, "source": {"schema": "ops", "table": table}, "after": {"dataset": "d"}}).encode()
    df = spark.createDataFrame([(bytearray(said("changes")),), (bytearray(said("other")),), (bytearray(b"{oops"),), (None,)], "value binary")
    assert [r["source"]["table"] for r in cdc.decoded(df, ["ops.changes"]).collect()] == ["changes"]
    assert cdc.decoded(df).count() == 4 and cdc.decoded(df, []).count() == 0


def test_database_tables(spark):
    url, driver = "jdbc:derby:memory:catalogue;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    put = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.format("jdbc").options(url=url, driver=driver, dbtable=name).mode("overwrite").save()
    put([(n if n % 7 else None, f"d{n}") for n in range(50)], "ID long, NAME string", "numbered")
    put([], "ID long, NAME string", "nothing")
    whole = relational.table(spark, url, "numbered", driver=driver)
    parts = relational.table(spark, url, "numbered", by="id", partitions=4, driver=driver)
    assert parts.rdd.getNumPartitions() == 4 and sorted(r["NAME"] for r in parts.collect()) == sorted(f"d{n}" for n in range(50))
    assert whole.count() == 50 and relational.table(spark, url, "nothing", by="id", driver=driver).count() == 0


def test_pending_changes_and_catalogue(spark):
    changes = spark.createDataFrame([("d", "c", "alter table d drop column c", False), ("e", None, None, None), ("f", None, "ALTER TABLE f", True)], "dataset string, column_name string, ddl string, processed boolean")
    assert [tuple(r) for r in relational.pending(changes).orderBy("dataset").collect()] == [("d", "c", "alter table d drop column c", True), ("e", None, None, False)]
    sets = spark.createDataFrame([("p", "d", "sql", "me", None, None), ("p", "d", "sql", "me", None, None)], "project string, name string, source_type string, owner string, sla_tier string, freshness_cadence string").selectExpr("*", "timestamp'2024-01-01' AS created_at")
    cols = spark.createDataFrame([("p", "d", "c")], "project string, dataset string, name string").selectExpr("*", "timestamp'2024-01-01' AS created_at")
    nodes = relational.catalog_nodes(sets, cols)
    assert sorted((r["label"], r["name"], r["sla_tier"], r["freshness_cadence"]) for r in nodes.collect()) == [("Column", "c", None, None), ("Dataset", "d", "P2", "daily")]
    wanted = spark.createDataFrame([("d", "c"), ("d", "x")], "dataset string, column string")
    assert [tuple(r) for r in C.missing_columns(nodes, wanted).collect()] == [("d", "x")]
    assert relational.catalog_nodes(sets.limit(0), cols.limit(0)).count() == 0


def test_seed_fills_a_store(spark, tmp_path):
    ref = lambda d, c: {"dataset": d, "column": c, "warehouse": "generic"}
    event = {"event_id": "e1", "source_type": "sql", "project_name": "mill", "ingested_at": "2024-01-01T00:00:00Z", "transform_id": "t1", "transform_name": "grind", "source_datasets": ["sacks"], "target_datasets": ["flour"], "column_derivations": [{"source": ref("sacks", "kg"), "target": ref("flour", "kg"), "is_passthrough": True}], "llm_inferred": False, "validation_status": "ok"}
    flour = [{"project": "mill", "name": "flour"}]
    things = [{"label": "Dashboard", "name": "Stock", "sla_tier": "P0", "reads": flour}, {"label": "Dashboard", "name": "Stock", "sla_tier": "P0", "reads": flour}, {"label": "MLFeature", "name": "demand", "project": "mill", "made_from": flour}, {"label": "Table", "name": "no"}]
    (tmp_path / "e.json").write_text(json.dumps([event]))
    (tmp_path / "a.json").write_text(json.dumps(things))
    store = U.GraphStore(spark, str(tmp_path / "g"))
    assert store.apply(seed.events(spark, str(tmp_path / "e.json")), "seed", seed.assets(spark, str(tmp_path / "a.json")))
    assert not store.apply(seed.events(spark, str(tmp_path / "e.json")), "seed")
    n, e = store.nodes(), store.edges()
    assert n.where("label in ('Dashboard', 'MLFeature', 'Table')").count() == 2
    names = e.join(n.selectExpr("node_id AS src", "name AS a"), "src").join(n.selectExpr("node_id AS dst", "name AS b"), "dst")
    assert {(r["a"], r["rel_type"], r["b"]) for r in names.where("rel_type in ('READS_FROM', 'PRODUCES')").collect()} == {("grind", "READS_FROM", "sacks"), ("Stock", "READS_FROM", "flour"), ("flour", "PRODUCES", "demand")}
    report = I.blast_radius(n, e, I.SchemaChange("sacks", "kg"))
    assert {"Stock", "demand", "flour"} <= {r["name"] for r in report["assets"].collect()}


def test_registry_over_http():
    class Registry(BaseHTTPRequestHandler):
        def do_GET(self):
            found = {"/subjects": ["a", "bad", "gone"], "/subjects/a/versions/latest": {"version": 3, "schema": "{}"}}.get(self.path)
            self.send_response(404 if found is None and "bad" not in self.path else 200)
            self.end_headers()
            self.wfile.write(b"not json" if "bad" in self.path else json.dumps(found).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Registry)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        assert registry.fetch(registry.http(f"http://127.0.0.1:{server.server_port}/")) == [{"subject": "a", "version": 3, "schemaType": "AVRO", "schema": "{}"}]
    finally:
        server.shutdown()
        server.server_close()
    assert registry.fetch(registry.http("http://127.0.0.1:9", timeout=1)) == []


def test_answers_of_a_model(spark):
    d = {"source_dataset": "s", "source_column": "a", "target_dataset": "t", "target_column": "b"}
    good = {"source_datasets": ["s"], "target_datasets": ["t"], "column_derivations": [d], "confidence": 0.9}
    said = {"good": json.dumps(good), "fenced": "```json\n" + json.dumps(good) + "\n```", "sure": json.dumps(good | {"confidence": 1.2}), "part": json.dumps(good | {"column_derivations": [{"source_dataset": "s"}]}), "lacks": json.dumps({"confidence": 0.5}), "kind": json.dumps(good | {"source_datasets": "s"}), "words": "I can't", "none": None, "empty": ""}
    got = {r["k"]: r["inferred"] for r in cdc.inferences(spark.createDataFrame(list(said.items()), "k string, answer string")).collect()}
    assert {k for k, v in got.items() if v} == {"good", "fenced"}
    assert got["fenced"]["column_derivations"][0].asDict() == d | {"expression": None, "is_passthrough": False} and got["good"]["confidence"] == 0.9
    assert "SELECT 1" in cdc.prompt("SELECT 1") and "source_datasets" in cdc.prompt("")


def test_jobs_wait_as_their_kind_says():
    waits, tries = [], []

    def work():
        tries.append(1)
        raise ValueError("no")

    jobs = cdc.Jobs(sleep=waits.append)
    assert jobs.run("a", work, "spark") == "FAILURE" and waits == [15, 15, 15] and len(tries) == 4
    assert jobs.run("b", work, "inference") == "FAILURE" and waits[3:] == [30, 30]
    assert jobs.run("c", lambda: 1, "sql") == "SUCCESS" and jobs.status("c")["result"] == 1 and jobs.status("d") == {"status": "PENDING"}


def test_a_job_over_its_time_is_cancelled(spark):
    with cdc.bounded(spark, "dbt", 60):
        assert spark.range(3).count() == 3 and spark.sparkContext.getLocalProperty("spark.scheduler.pool") == "dbt"
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None
    began = time.monotonic()
    with pytest.raises(Exception, match="(?i)cancel"), cdc.bounded(spark, "sql", 1):
        spark.range(1 << 50).selectExpr("sum(hash(id))").collect()
    assert time.monotonic() - began < 60 and spark.range(3).count() == 3


def test_numbers_of_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"op":"c"}\n{"op":"d"}\n')
    seen = cdc.Progress()
    spark.streams.addListener(seen)
    try:
        q = cdc.envelopes(spark, str(tmp_path / "in")).writeStream.foreachBatch(lambda df, _: df.count()).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(60)
        for _ in range(50):
            if seen.held.get(str(q.id), {}).get("batches"):
                break
            time.sleep(0.2)
        own = seen.held[str(q.id)]
        assert own["batches"] >= 1 and own["rows"] >= 2 and own["error"] is None
    finally:
        spark.streams.removeListener(seen)


def test_properties_of_queries():
    ask = lambda q: nlq.validate(q, properties=True)
    assert ask("MATCH (d:Dataset {project: 'x: y'})<-[:WRITES_TO]-(t:Transform) WHERE t.raw_sql = 'd.size' RETURN d.name") == []
    assert ask("MATCH (d:Dataset {size: 'x'}) RETURN d.rows, d.name") == ["unknown property: Dataset.rows", "unknown property: Dataset.size"]
    assert ask("MATCH (s:Snapshot)--(n) RETURN s.any, n.any") == []
    assert nlq.validate("MATCH (d:Dataset) RETURN d.rows") == []


def test_what_is_shown_and_clicked():
    assert nlq.suggested() == nlq.SUGGESTIONS[:6]
    assert I.clicked("Column", "c", "d") == I.SchemaChange("d", "c") and I.clicked("Column", "c") == I.SchemaChange("c", "c")
    assert I.clicked("Dataset", "d", "x") == I.SchemaChange("d") and I.clicked("Pipeline", "l") is None
