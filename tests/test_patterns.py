"""Graph patterns on a small graph by hand: the kinds of questions that are asked, and what is refused."""

import pytest

from tracewell.plans.patterns import graph_query

NODES = [
    ("d1", "Dataset", "raw_events", "p", None, "kafka", None, None), ("d2", "Dataset", "facts", "p", "ann", "dbt", None, None), ("d3", "Dataset", "mart", "q", "", "sql", None, None), ("t1", "Transform", "load", "p", None, "dbt", None, True), ("t2", "Transform", "sum", "p", None, "spark", None, False),
    ("p1", "Pipeline", "nightly", "p", None, None, None, None), ("b1", "Dashboard", "revenue", None, None, None, "P0", None), ("b2", "Dashboard", "other", None, None, None, "P1", None), ("f1", "MLFeature", "churn", None, None, None, None, None),
    ("c1", "Column", "a", "p", None, None, None, None), ("c2", "Column", "b", "p", None, None, None, None), ("c3", "Column", "c", "p", None, None, None, None),
]
EDGES = [
    ("t1", "d1", "READS_FROM"), ("t1", "d2", "WRITES_TO"), ("t2", "d2", "READS_FROM"), ("t2", "d3", "WRITES_TO"), ("t1", "p1", "PART_OF"), ("t2", "p1", "PART_OF"), ("b1", "d3", "READS_FROM"), ("b1", "d2", "READS_FROM"), ("b2", "d3", "READS_FROM"), ("t2", "f1", "PRODUCES"),
    ("c2", "c1", "DERIVES_FROM"), ("c3", "c2", "DERIVES_FROM"), ("c3", "c1", "DERIVES_FROM"), ("c3", "d2", "PART_OF"), ("c1", "c1", "DERIVES_FROM"),
]


@pytest.fixture(scope="module")
def g(spark):
    nodes = spark.createDataFrame(NODES, "node_id string, label string, name string, project string, owner string, source_type string, sla_tier string, llm_inferred boolean").selectExpr("*", "'facts' as dataset", "cast(null as string) as created_at")
    return nodes, spark.createDataFrame(EDGES, "src string, dst string, rel_type string")


ASKED = {
    "MATCH (dash:Dashboard {name: 'revenue'}) MATCH (t:Transform)-[:WRITES_TO]->(d:Dataset)<-[:READS_FROM]-(t2:Transform)-[:PART_OF]->(p:Pipeline) WHERE EXISTS { MATCH (dash)-[:READS_FROM]->(d) } RETURN DISTINCT p.name AS pipeline, d.name AS shared": [("nightly", "facts")],
    "MATCH (c:Column {dataset: 'facts', name: 'a'}) MATCH path = (c)<-[:DERIVES_FROM*1..6]-(x) WHERE x:MLFeature OR (x:Column AND EXISTS { MATCH (x)-[:PART_OF]->(:Dataset)<-[:READS_FROM]-(:Transform)-[:PRODUCES]->(:MLFeature) }) RETURN DISTINCT x.name AS affected, labels(x)[0] AS type": [("c", "Column")],
    "MATCH (d:Dataset) WHERE NOT EXISTS { MATCH (d) WHERE d.owner IS NOT NULL } MATCH (d)<-[:READS_FROM|WRITES_TO]-(t:Transform) WITH d, count(DISTINCT t) AS n WHERE n > 0 RETURN d.name AS dataset, n ORDER BY n DESC": [("raw_events", 1)],
    "MATCH (c:Column {dataset: 'facts', name: 'a'}) MATCH (c)<-[:DERIVES_FROM*1..5]-(down:Column) RETURN DISTINCT down.name AS name, labels(down)[0] AS type ORDER BY name": [("a", "Column"), ("b", "Column"), ("c", "Column")],
    "MATCH (src:Dataset {name: 'raw_events', source_type: 'kafka'}) MATCH (t:Transform)-[:READS_FROM]->(src) WHERE t.source_type = 'dbt' RETURN t.name AS model, t.project": [("load", "p")],
    "MATCH (d:Dataset {name: 'facts'}) MATCH path = (up)-[:READS_FROM|WRITES_TO|DERIVES_FROM*1..4]->(d) RETURN path, length(path) AS n LIMIT 100": [(["b1", "d2"], 1), (["t1", "d2"], 1), (["t2", "d2"], 1)],
    "MATCH (t:Transform) WHERE t.llm_inferred = true RETURN t.name AS transform ORDER BY t.created_at DESC": [("load",)],
    "MATCH (col:Column)-[:DERIVES_FROM]->(src:Column) WITH col, count(DISTINCT src) AS n WHERE n > 1 RETURN col.name AS name, n": [("c", 2)],
    "MATCH (f:MLFeature {name: 'churn'}) MATCH path = (t:Transform)-[:PRODUCES|WRITES_TO*1..6]->(f) RETURN DISTINCT t.name AS t, length(path) AS hops": [("sum", 1)],
    "MATCH (p:Pipeline {name: 'nightly'}) MATCH (p)<-[:PART_OF]-(t:Transform)-[:WRITES_TO]->(d:Dataset)<-[:READS_FROM*1..4]-(dash:Dashboard) WHERE dash.sla_tier = 'P0' RETURN count(DISTINCT dash) AS n": [(1,)],
    "MATCH (d:Dataset) OPTIONAL MATCH (d)<-[:READS_FROM]-(b:Dashboard) WHERE b.sla_tier = 'P1' RETURN d.name AS d, b.name AS b, count(*) AS n": [("facts", None, 1), ("mart", "other", 1), ("raw_events", None, 1)],
    "MATCH (a:Column)-[:DERIVES_FROM]->(b:Column)-[:DERIVES_FROM]->(a) RETURN a.name AS a": [("a",)],
    "MATCH (d:Dataset) WHERE NOT EXISTS { MATCH (d)<-[:READS_FROM]-(:Dashboard) } AND d.name <> 'x' RETURN d.name": [("raw_events",)],
    "MATCH (b:Dashboard)-[:READS_FROM]->(d) RETURN b.name AS b, collect(DISTINCT d.name) AS ds ORDER BY b LIMIT 1": [("other", ["mart"])],
    "MATCH (a:Dataset {name: 'raw_events'})-[:READS_FROM|WRITES_TO*2..3]-(x) RETURN DISTINCT x.name AS x": [("facts",), ("load",), ("sum",), ("revenue",), ("raw_events",)],
    "MATCH (n:Dashboard) WHERE n.name IN ['other'] OR n.name CONTAINS 'venu' AND NOT n.sla_tier = 'P1' RETURN toUpper(n.name) AS u": [("OTHER",), ("REVENUE",)],
    "MATCH (t:Transform) WITH t.project AS project, count(t) AS n RETURN project, n": [("p", 2)],
}


@pytest.mark.parametrize("query", ASKED)
def test_rows(g, query):
    assert sorted((tuple(r) for r in graph_query(query, *g).collect()), key=repr) == sorted(ASKED[query], key=repr)


REFUSED = [
    "MATCH (t:Table) RETURN t", "MATCH (d:Dataset) DELETE d", "MATCH (a:Dataset), (b:Pipeline) RETURN a.name, b.name", "MATCH (a:Dataset)-[:READS_FROM*1..20]->(b) RETURN b.name", "MATCH (d:Dataset) RETURN d.name ORDER", "MATCH (d:Dataset RETURN d.name", "RETURN", "MATCH (d:Dataset) WHERE d.name ~ 'x' RETURN d.name",
    "MATCH (d:Dataset) WHERE nosuch(d.name) = 'x' RETURN d.name", "MATCH (d:Dataset) WHERE x.name = 'a' RETURN d.name", "MATCH (d:Dataset) RETURN d.name extra", "CALL x()", "MATCH (d:Dataset) OPTIONAL MATCH (x)-[:READS_FROM]->(y) RETURN d.name",
]


@pytest.mark.parametrize("query", REFUSED)
def test_what_is_refused(g, query):
    with pytest.raises(ValueError):
        graph_query(query, *g)
