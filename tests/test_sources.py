import json

from pyspark.sql import functions as F

from tracewell.sources import dbt, plan_json, registry

AVRO = {"type": "record", "name": "Parcel", "fields": [{"name": "barcode", "type": "string"}, {"name": "depot", "type": ["null", "string"]}, {"name": "grams", "type": "long"}, {"name": "stamps", "type": {"type": "array", "items": "int"}}]}
JSONS = {"properties": {"id": {"type": "integer"}, "opt": {"type": ["string", "null"]}, "free": {"type": "string"}}, "required": ["id"]}


def subjects(spark):
    rows = [("parcels-value", 1, "AVRO", json.dumps(AVRO)), ("j-key", 2, "JSON", json.dumps(JSONS)), ("bad", 1, "AVRO", "{oops"), ("p", 1, "PROTOBUF", "x")]
    return spark.createDataFrame(rows, "subject string, version int, schemaType string, schema string")


def test_registry_columns(spark):
    got = {(r["subject"], r["name"]): (r["type"], r["nullable"]) for r in registry.subject_columns(subjects(spark)).collect()}
    assert got == {
        ("parcels-value", "barcode"): ("string", False), ("parcels-value", "depot"): ("string", True), ("parcels-value", "grams"): ("bigint", False), ("parcels-value", "stamps"): ("array", False),
        ("j-key", "id"): ("integer", False), ("j-key", "opt"): ("string", True), ("j-key", "free"): ("string", True),
    }


def test_registry_events(spark):
    rows = registry.events(subjects(spark), "p", topics="parcel", semantics="as_implemented").collect()
    assert [r["target_datasets"] for r in rows] == [["kafka.parcels"]] and len(rows[0]["column_derivations"]) == 4


def test_fetch_tolerates_failures():
    def get(path):
        if path == "/subjects":
            return ["a", "b"]
        if "/a/" in path:
            raise OSError
        return {"schema": "{}"}

    assert [x["subject"] for x in registry.fetch(get)] == ["b"]
    assert registry.fetch(lambda path: None) == [] and registry.fetch(lambda path: {"a": 1}) == []
    assert registry.fetch(lambda path: ["a", "b"] if path == "/subjects" else None if "/a/" in path else []) == []


def node(kind, package, name, folder, needs=(), **more):
    """A node of a manifest: ``folder`` is its schema, ``needs`` the keys that it depends on."""
    return f"{kind}.{package}.{name}", {"resource_type": kind, "package_name": package, "name": name, "schema": folder, "fqn": [package, "daily", name], "config": {"materialized": more.pop("made", "view"), "enabled": more.pop("on", True)}, "depends_on": {"nodes": list(needs)}, **more}


#: A seed, a snapshot of it, and three models in a row over two packages, of which one goes by an alias and one is compiled the newer way.
SHOP = dict([
    node("seed", "atlas", "ports", "ref", made="seed", columns={"code": {"name": "code"}}),
    node("snapshot", "atlas", "ports_history", "hist", ["seed.atlas.ports"], compiled_sql="SELECT p.*, current_date() AS seen FROM ref.ports p"),
    node("model", "fleet", "calls", "stage", ["snapshot.atlas.ports_history", "source.fleet.gps.pings"], alias="port_calls", compiled_code="SELECT h.code, count(g.ship) AS ships FROM hist.ports_history h JOIN gps.pings g ON g.near = h.code GROUP BY h.code"),
    node("model", "fleet", "busy", "mart", ["model.fleet.calls"], compiled_sql="SELECT code, ships > 9 AS busy FROM stage.port_calls", tags=["kpi"]),
    node("model", "fleet", "broken", "", ["model.fleet.busy", "model.fleet.unknown"], compiled_sql="{% oops %}", columns={"code": {"name": "code"}}),
    node("test", "fleet", "not_null", "t", ["model.fleet.busy"], compiled_sql="SELECT 1"),
    node("model", "fleet", "off", "mart", ["model.fleet.busy"], on=False),
])
PINGS = {"source.fleet.gps.pings": {"name": "pings", "source_name": "gps", "resource_type": "source"}}


def test_dbt(spark, tmp_path):
    p = tmp_path / "manifest.json"
    p.write_text(json.dumps({"nodes": SHOP, "sources": PINGS}))
    got = {e["target_datasets"][0]: e for e in dbt.ingest(spark, str(p), "sea", "c1")}
    assert {t: e["source_datasets"] for t, e in got.items()} == {"hist.ports_history": ["ref.ports"], "stage.port_calls": ["hist.ports_history", "gps.pings"], "mart.busy": ["stage.port_calls"], "broken": ["mart.busy"]}
    assert {e["pipeline_name"] for e in got.values()} == {"atlas", "fleet"} and {e["commit_id"] for e in got.values()} == {"c1"}
    columns = {(d["target"]["dataset"], d["target"]["column"], d["source"]["dataset"], d["source"]["column"]) for e in got.values() for d in e["column_derivations"]}
    assert columns == {("hist.ports_history", "*", "ref.ports", "*"), ("stage.port_calls", "code", "hist.ports_history", "code"), ("stage.port_calls", "ships", "gps.pings", "ship"), ("mart.busy", "code", "stage.port_calls", "code"), ("mart.busy", "busy", "stage.port_calls", "ships"), ("broken", "code", "mart.busy", "code")}
    # All models at once give the same columns.
    rows = dbt.lineage(dbt.models(dbt.read_manifest(spark, str(p)))).collect()
    assert {(r["target"], r["column"], r["source_dataset"], r["source_column"]) for r in rows} == columns


def test_plan_without_a_write():
    assert plan_json.extract({"class": "o.LocalRelation"}, "p") == []


def test_flat_plan_of_a_real_query(spark):
    df = spark.range(3).select((F.col("id") + 1).alias("n"))
    tree = plan_json.nested(df._jdf.queryExecution().analyzed().toJSON())
    assert plan_json.kind(tree) == "Project" and plan_json.kind(tree["children"][0]) == "Range"
