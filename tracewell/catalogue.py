"""The lineage queries over the driver's tables and their DuckDB SQL."""

from __future__ import annotations


from pyspark.sql import functions as F

from tracewell.operators import catalog as C
from tracewell.operators import impact as I
from tracewell.operators import layout, many
from tracewell.operators import traverse as T
from tracewell.plans.bridge import PRELUDE, graph
from tracewell.plans.patterns import graph_query

_ALL = "('Dataset','Column','Transform','Pipeline','Dashboard','MLFeature')"
_CHANGE = I.SchemaChange("p:5", "k:5", "drop_column")
_TABLE = I.SchemaChange("p:5", None, "drop_table")


def _starts(nodes, *ids):
    return nodes.where(F.col("node_id").isin(*ids)).select("node_id")


def _on(f):
    return lambda spark, sf_dir: f(*graph(spark, sf_dir))


def _reach(n, e, rels=None, direction="out", depth=8, start="k:5", label=None, most=None):
    own = None if label is None else n.where(F.col("label") == label).select("node_id")
    out = T.bfs(T.hops(e, rels, direction), _starts(n, start), depth, nearest=most, of=own)
    out = out if own is None else out.join(own, "node_id", "left_semi")
    return out if most is None else out.orderBy("level", "node_id").limit(most)


def _reach_sql(rels=None, direction="out", depth=8, start="k:5", label=None, level="level"):
    a, b = {"out": ("src", "dst"), "in": ("dst", "src")}.get(direction, ("src", "dst"))
    some = "" if rels is None else " WHERE rel_type IN (" + ", ".join(f"'{r}'" for r in rels) + ")"
    pairs = f"SELECT DISTINCT {a} AS a, {b} AS b FROM edges{some}" if direction != "both" else f"SELECT src AS a, dst AS b FROM edges{some} UNION SELECT dst, src FROM edges{some}"
    keep = f" JOIN nodes USING (node_id) WHERE label = '{label}'" if label else ""
    return f"""{PRELUDE}, pairs AS ({pairs}),
    walk(node_id, level) AS (SELECT '{start}', 0 UNION SELECT b, level + 1 FROM walk JOIN pairs ON a = node_id WHERE level < {depth}),
    best AS (SELECT node_id, min(level) AS level FROM walk GROUP BY node_id)
    SELECT node_id, {level} FROM (SELECT * FROM best WHERE level > 0) {keep}"""


def _undirected_sql(start: str, label: str, most: int) -> str:
    """Up to eight hops both ways. The walk is a row for each node and hop, each hop from the nodes that the one before met."""
    walks = "".join(f", l{k} AS (SELECT DISTINCT b AS node_id FROM l{k - 1} JOIN pairs ON a = node_id WHERE b NOT IN (SELECT node_id FROM s{k - 1})), s{k} AS (SELECT node_id FROM s{k - 1} UNION ALL SELECT node_id FROM l{k})" for k in range(1, 9))
    every = " UNION ALL ".join(f"SELECT node_id, {k} AS level FROM l{k}" for k in range(1, 9))
    return f"""{PRELUDE}, pairs AS MATERIALIZED (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), l0 AS (SELECT '{start}' AS node_id), s0 AS (SELECT node_id FROM l0){walks}
    SELECT node_id, level FROM ({every}) JOIN nodes USING (node_id) WHERE label = '{label}' ORDER BY level, node_id LIMIT {most}"""


_WALK = """pairs AS (SELECT DISTINCT src AS a, dst AS b FROM edges), walk(node_id, level) AS (SELECT '{start}', 0 UNION SELECT b, level + 1 FROM walk JOIN pairs ON a = node_id WHERE level < 8),
    reach AS (SELECT DISTINCT node_id FROM walk WHERE node_id <> '{start}')"""
_SCORE = f"""round(least((CASE sla_tier WHEN 'P0' THEN 1.0::DOUBLE WHEN 'P1' THEN 0.6::DOUBLE ELSE 0.2::DOUBLE END) * 0.5::DOUBLE
    + (CASE cadence WHEN 'streaming' THEN 1.0::DOUBLE WHEN 'hourly' THEN 0.8::DOUBLE WHEN 'weekly' THEN 0.2::DOUBLE ELSE 0.5::DOUBLE END) * 0.3::DOUBLE
    + ln(fan + 1.0::DOUBLE) / ln({I.FULL}.0::DOUBLE) * 0.2::DOUBLE, 1.0::DOUBLE), 4)"""


def _action_sql(change: I.SchemaChange) -> str:
    cases = " ".join(f"WHEN '{a}' THEN '{t}'" for a, k, t in I.ACTIONS if k == change.change_type)
    general = f"'Review usage of {change.dataset}.{change.column or '*'}'"
    return f"CASE label {cases} ELSE {general} END" if cases else general


def _ranked_sql(change: I.SchemaChange, reach: str, first: str, labels: str = _ALL) -> str:
    return f"""{PRELUDE}, {reach},
    assets AS (SELECT n.node_id, label, coalesce(name, dataset, '') AS name, coalesce(sla_tier, 'P2') AS sla_tier, coalesce(freshness_cadence, 'daily') AS cadence, coalesce(fan, 0) AS fan
        FROM nodes n JOIN reach USING (node_id) LEFT JOIN fan USING (node_id) WHERE label IN {labels}{first}),
    top AS (SELECT *, {_SCORE} AS criticality_score FROM assets ORDER BY criticality_score DESC, fan DESC, node_id LIMIT {I.KEPT})
    SELECT node_id, label AS node_type, name, sla_tier, fan AS downstream_fan_out, cadence AS freshness_cadence, criticality_score, {_action_sql(change)} AS suggested_action FROM top"""


_FAN_IN = "fan AS (SELECT dst AS node_id, count(DISTINCT src) AS fan FROM edges{where} GROUP BY dst)"
_FLOW = """flow AS (SELECT dst AS src, src AS dst, 'FEEDS' AS k FROM edges WHERE rel_type = 'DERIVES_FROM' AND src <> dst
    UNION ALL SELECT dst, src, 'READ_BY' FROM edges WHERE rel_type = 'READS_FROM'
    UNION ALL SELECT src, dst, 'WRITES_TO' FROM edges WHERE rel_type = 'WRITES_TO'
    UNION ALL SELECT src, dst, 'PRODUCES' FROM edges WHERE rel_type = 'PRODUCES'
    UNION ALL SELECT src, dst, CASE WHEN src LIKE 'k:%' THEN 'COLUMN_OF' ELSE 'RUNS_IN' END FROM edges WHERE rel_type = 'PART_OF'
    UNION ALL SELECT dst, transform_id, 'CONSUMED_BY' FROM edges WHERE rel_type = 'DERIVES_FROM' AND transform_id IS NOT NULL)"""
_FLOW_FAN = "fan AS (SELECT src AS node_id, count(DISTINCT dst) AS fan FROM flow GROUP BY src)"
_COLUMN_FLOW = f"""{_FLOW}, cols(node_id, level) AS (SELECT 'k:5', 0 UNION SELECT dst, level + 1 FROM cols JOIN flow ON src = node_id AND k = 'FEEDS' WHERE level < 8),
    cc AS (SELECT DISTINCT node_id FROM cols WHERE node_id <> 'k:5'),
    sets AS (SELECT DISTINCT dst AS node_id FROM flow JOIN cc ON src = node_id AND k = 'COLUMN_OF'),
    users AS (SELECT dst AS node_id FROM flow JOIN (SELECT node_id FROM cc UNION SELECT 'k:5') u ON src = node_id AND k = 'CONSUMED_BY'
        UNION SELECT dst FROM flow JOIN sets ON src = node_id AND k IN ('READ_BY', 'PRODUCES')),
    reach AS (SELECT node_id FROM cc UNION SELECT node_id FROM sets UNION SELECT node_id FROM users UNION SELECT dst FROM flow JOIN users ON src = node_id AND k = 'RUNS_IN'),
    {_FLOW_FAN}"""
_TABLE_FLOW = f"""{_FLOW}, pairs AS (SELECT DISTINCT src, dst FROM flow WHERE k <> 'COLUMN_OF'),
    walk(node_id, level) AS (SELECT 'p:5', 0 UNION SELECT dst, level + 1 FROM walk JOIN pairs ON src = node_id WHERE level < 8),
    reach AS (SELECT DISTINCT node_id FROM walk WHERE node_id <> 'p:5'), {_FLOW_FAN}"""


def _ranked(change, semantics):
    column = change.column is not None

    def run(n, e):
        starts = I.starts_of(n, change)
        return I.ranked(n, I.affected(n, e, starts, semantics, column), change, column, semantics)

    return _on(run)


def _scores(spark, sf_dir):
    tiers, cadences = ["P0", "P1", "P2", None], ["streaming", "hourly", "daily", "weekly", "never"]
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_partkey").agg(F.count_distinct("l_orderkey").alias("fan"))
    pick = lambda names, k: F.get(F.array(*map(F.lit, names)), F.expr(f"cast(l_partkey % {k} as int)"))
    return lines.select("l_partkey", I.score(pick(tiers, 4), pick(cadences, 5), F.col("fan")).alias("score"))


def _flatten(col):
    return F.array_join(col, ",")


def _trail(n, e):
    return T.longest_trail(e, _starts(n, "k:5", "k:1"), ["READS_FROM", "DERIVES_FROM"], acyclic=True).select("start", _flatten("chain").alias("chain"))


_TRAIL = f"""{PRELUDE}, back AS (SELECT DISTINCT dst AS a, src AS b FROM edges WHERE rel_type IN ('READS_FROM', 'DERIVES_FROM')),
    t(start, node_id, chain, n) AS (SELECT 'k:' || i, 'k:' || i, ['k:' || i], 0 FROM (VALUES (1), (5)) v(i) UNION ALL SELECT start, b, list_prepend(b, chain), n + 1 FROM t JOIN back ON a = node_id WHERE n < 8),
    leaf AS (SELECT * FROM t WHERE n > 0 AND node_id NOT IN (SELECT a FROM back)),
    r AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY n DESC, chain) AS k FROM leaf)
    SELECT start, array_to_string(chain, ',') AS chain FROM r WHERE k = 1"""


def _circular(n, e):
    """Every 97th column also feeds the one that it is derived from."""
    turn = n.where("label = 'Column'").withColumn("k", F.expr("cast(substr(node_id, 3) as long)")).where("k >= 3 and k % 97 = 0")
    turn = turn.select(F.concat(F.lit("k:"), F.expr("k div 3")).alias("src"), F.col("node_id").alias("dst"), F.lit("DERIVES_FROM").alias("rel_type"))
    all_ = e.select("src", "dst", "rel_type").unionAll(turn)
    return T.longest_trail(all_, _starts(n, "k:5", "k:1", "k:97"), ["READS_FROM", "DERIVES_FROM"]).select("start", _flatten("chain").alias("chain"))


_CIRCULAR = f"""{PRELUDE}, back AS MATERIALIZED (SELECT dst AS a, src AS b FROM edges WHERE rel_type IN ('READS_FROM', 'DERIVES_FROM')
        UNION SELECT node_id, 'k:' || (substr(node_id, 3)::BIGINT // 3) FROM nodes WHERE label = 'Column' AND substr(node_id, 3)::BIGINT % 97 = 0 AND substr(node_id, 3)::BIGINT >= 3),
    t(start, node_id, chain, used, n) AS (SELECT 'k:' || i, 'k:' || i, ['k:' || i], []::VARCHAR[], 0 FROM (VALUES (1), (5), (97)) v(i)
        UNION ALL SELECT start, b, list_prepend(b, chain), list_append(used, a || '|' || b), n + 1 FROM t JOIN back ON a = node_id WHERE n < 8 AND NOT list_contains(used, a || '|' || b)),
    leaf AS (SELECT * FROM t WHERE n > 0 AND node_id NOT IN (SELECT a FROM back)),
    r AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY n DESC, chain) AS k FROM leaf)
    SELECT start, array_to_string(chain, ',') AS chain FROM r WHERE k = 1"""


def _report(n, e):
    return I.counts(I.ranked(n, I.affected(n, e, I.starts_of(n, _CHANGE)), _CHANGE, kept=None), _CHANGE)


def _some(col: str, one: str) -> str:
    return f"CASE WHEN {col} > 0 THEN ' ' || {col} || ' {one}' || CASE WHEN {col} > 1 THEN 's' ELSE '' END || '.' ELSE '' END"


_RANKED_DOC = _ranked_sql(_CHANGE, _COLUMN_FLOW, "")
_REPORT = f"""WITH r AS ({_RANKED_DOC.replace(f"LIMIT {I.KEPT}", "")}), c AS (SELECT count(*) AS total, count(*) FILTER (sla_tier = 'P0') AS p0_count, count(*) FILTER (sla_tier = 'P1') AS p1_count,
    count(*) FILTER (node_type = 'Dashboard') AS dashboards, count(*) FILTER (node_type = 'MLFeature') AS features, count(*) FILTER (node_type = 'Dataset') AS datasets FROM r)
    SELECT *, total - p0_count - p1_count AS p2_count, 'Changing p:5.k:5 (drop_column) affects ' || total || ' downstream assets.' || {_some('p0_count', 'P0 asset')} || {_some('p1_count', 'P1 asset')}
    || {_some('dashboards', 'dashboard')} || {_some('features', 'ML feature pipeline')} || {_some('datasets', 'downstream dataset')} AS summary FROM c"""


def _missing(n, e):
    spark = n.sparkSession
    return C.missing_columns(n, spark.createDataFrame([("p:5", "k:5"), ("p:5", "k:6"), ("nope", "a"), ("p:1", "*")], "dataset string, column string"))


def _neighbours(n, e):
    return T.fan_out(n, e, ["READS_FROM", "WRITES_TO", "DERIVES_FROM", "PRODUCES"])


_T = "SELECT node_id AS {a} FROM nodes WHERE label = 'Transform'"

def _many(n, e, label="Column"):
    own = n.where(F.col("label") == label).select("node_id")
    return many.reports(n, e, own, column=label == "Column")


def _many_sql(reach: str, start: str, labels: str) -> str:
    """A report for each start, from (start, node_id) of what each reaches."""
    return f"""{PRELUDE}, {reach}, {_FLOW_FAN},
    scored AS (SELECT node_id, label, coalesce(sla_tier, 'P2') AS sla_tier, coalesce(freshness_cadence, 'daily') AS cadence, coalesce(fan, 0) AS fan FROM nodes LEFT JOIN fan USING (node_id) WHERE label IN {labels}),
    assets AS (SELECT start, label, sla_tier, {_SCORE} AS score FROM reach JOIN scored USING (node_id) WHERE start <> node_id)
    SELECT s.node_id, count(label) AS total, count(*) FILTER (sla_tier = 'P0') AS p0_count, count(*) FILTER (sla_tier = 'P1') AS p1_count, count(*) FILTER (label = 'Dashboard') AS dashboards,
        count(*) FILTER (label = 'MLFeature') AS features, count(*) FILTER (label = 'Dataset') AS datasets, max(score) AS top_score
    FROM (SELECT node_id FROM nodes WHERE {start}) s LEFT JOIN assets ON start = s.node_id GROUP BY s.node_id"""


_MANY_COLUMNS = f"""{_FLOW}, cols(start, node_id, level) AS (SELECT node_id, node_id, 0 FROM nodes WHERE label = 'Column' UNION SELECT start, dst, level + 1 FROM cols JOIN flow ON src = node_id AND k = 'FEEDS' WHERE level < 8),
    cc AS (SELECT DISTINCT start, node_id FROM cols WHERE node_id <> start),
    sets AS (SELECT DISTINCT start, dst AS node_id FROM flow JOIN cc ON src = node_id AND k = 'COLUMN_OF'),
    users AS (SELECT start, dst AS node_id FROM flow JOIN (SELECT start, node_id FROM cc UNION SELECT node_id, node_id FROM nodes WHERE label = 'Column') u ON src = node_id AND k = 'CONSUMED_BY'
        UNION SELECT start, dst FROM flow JOIN sets ON src = node_id AND k IN ('READ_BY', 'PRODUCES')),
    reach AS (SELECT start, node_id FROM cc UNION SELECT start, node_id FROM sets UNION SELECT start, node_id FROM users UNION SELECT start, dst FROM flow JOIN users ON src = node_id AND k = 'RUNS_IN')"""

def _pattern(text: str):
    return _on(lambda n, e: graph_query(text, n, e))


def _on_optional(text: str):
    return _on(lambda n, e: graph_query(text, n, e).withColumn("pipelines", _flatten("pipelines")))


_PATTERNS = {
    "j09_shared_datasets": (
        _pattern("MATCH (dash:Dashboard {name: 'Supplier#000000005'}) MATCH (t:Transform)-[:READS_FROM]->(d:Dataset), (t)-[:PART_OF]->(p:Pipeline) WHERE EXISTS { MATCH (dash)-[:READS_FROM]->(d) } RETURN DISTINCT p.name AS pipeline, d.name AS dataset"),
        f"{PRELUDE}, x AS (SELECT dst FROM edges JOIN nodes ON src = node_id WHERE label = 'Dashboard' AND name = 'Supplier#000000005' AND rel_type = 'READS_FROM') SELECT DISTINCT l.name AS pipeline, d.name AS dataset FROM x JOIN edges r ON r.dst = x.dst AND r.rel_type = 'READS_FROM' AND r.src LIKE 't:%' JOIN edges m ON m.src = r.src AND m.rel_type = 'PART_OF' JOIN nodes l ON l.node_id = m.dst AND l.label = 'Pipeline' JOIN nodes d ON d.node_id = x.dst",
    ),
    "j09_affected_columns": (
        _pattern("MATCH (c:Column {name: 'k:5'}) MATCH path = (c)<-[:DERIVES_FROM*1..6]-(x) WHERE x:MLFeature OR (x:Column AND EXISTS { MATCH (x)-[:PART_OF]->(:Dataset)<-[:READS_FROM]-(:Transform)-[:WRITES_TO]->(:Dataset)-[:PRODUCES]->(:MLFeature {name: 'NATION_3'}) }) RETURN DISTINCT x.name AS affected, labels(x)[0] AS type"),
        f"""{PRELUDE}, walk(node_id, n) AS (SELECT 'k:5', 0 UNION SELECT src, n + 1 FROM walk JOIN edges ON dst = node_id AND rel_type = 'DERIVES_FROM' WHERE n < 6),
        fed AS (SELECT DISTINCT p.src AS node_id FROM edges p JOIN edges r ON r.dst = p.dst AND r.rel_type = 'READS_FROM' AND r.src LIKE 't:%' JOIN edges w ON w.src = r.src AND w.rel_type = 'WRITES_TO' JOIN edges m ON m.src = w.dst AND m.rel_type = 'PRODUCES' JOIN nodes f ON f.node_id = m.dst AND f.name = 'NATION_3' WHERE p.rel_type = 'PART_OF' AND p.src LIKE 'k:%')
        SELECT DISTINCT name AS affected, label AS type FROM walk JOIN nodes USING (node_id) WHERE n > 0 AND (label = 'MLFeature' OR node_id IN (SELECT node_id FROM fed))""",
    ),
    "j09_unowned_datasets": (
        _pattern("MATCH (d:Dataset) WHERE NOT EXISTS { MATCH (d) WHERE d.owner IS NOT NULL } MATCH (d)<-[:READS_FROM|WRITES_TO]-(t:Transform) WITH d, count(DISTINCT t) AS dep_count WHERE dep_count > 5 RETURN d.name AS dataset, dep_count ORDER BY dep_count DESC"),
        f"{PRELUDE} SELECT name AS dataset, count(DISTINCT src) AS dep_count FROM nodes JOIN edges ON dst = node_id WHERE label = 'Dataset' AND owner IS NULL AND rel_type IN ('READS_FROM', 'WRITES_TO') AND src LIKE 't:%' GROUP BY node_id, name HAVING count(DISTINCT src) > 5",
    ),
    "j09_column_sources": (
        _pattern("MATCH (col:Column)-[:DERIVES_FROM]->(src:Column) WITH col, count(DISTINCT src) AS source_count WHERE source_count > 1 RETURN col.dataset AS dataset, col.name AS name, source_count"),
        f"{PRELUDE} SELECT dataset, name, count(DISTINCT dst) AS source_count FROM nodes JOIN edges ON src = node_id WHERE rel_type = 'DERIVES_FROM' GROUP BY node_id, dataset, name HAVING count(DISTINCT dst) > 1",
    ),
    "j09_optional_readers": (
        _on_optional("MATCH (d:Dataset) WHERE d.project STARTS WITH 'Brand#1' OR NOT d.source_type IN ['dbt', 'spark'] OPTIONAL MATCH (d)<-[:READS_FROM]-(t:Transform)-[:PART_OF]->(p:Pipeline) WHERE t.llm_inferred = true RETURN d.name AS dataset, count(DISTINCT t) AS transforms, collect(DISTINCT p.name) AS pipelines"),
        f"{PRELUDE}, u AS (SELECT r.dst, t.node_id AS t, p.name AS p FROM edges r JOIN nodes t ON r.src = t.node_id AND t.label = 'Transform' AND t.llm_inferred JOIN edges m ON m.src = t.node_id AND m.rel_type = 'PART_OF' JOIN nodes p ON p.node_id = m.dst WHERE r.rel_type = 'READS_FROM') SELECT d.name AS dataset, count(DISTINCT t) AS transforms, coalesce(string_agg(DISTINCT p, ',' ORDER BY p), '') AS pipelines FROM nodes d LEFT JOIN u ON u.dst = d.node_id WHERE d.label = 'Dataset' AND (d.project LIKE 'Brand#1%' OR d.source_type NOT IN ('dbt', 'spark')) GROUP BY d.node_id, d.name",
    ),
    "j09_pipeline_dashboards": (
        _pattern("MATCH (p:Pipeline {name: '1-URGENT'}) MATCH (p)<-[:PART_OF]-(t:Transform)-[:READS_FROM]->(d:Dataset)<-[:READS_FROM*1..4]-(dash:Dashboard) WHERE dash.sla_tier = 'P0' RETURN count(DISTINCT dash) AS p0_dashboard_count"),
        f"{PRELUDE} SELECT count(DISTINCT s.node_id) AS p0_dashboard_count FROM edges m JOIN nodes l ON l.node_id = m.dst AND l.label = 'Pipeline' AND l.name = '1-URGENT' JOIN edges r ON r.src = m.src AND r.rel_type = 'READS_FROM' JOIN edges b ON b.dst = r.dst AND b.rel_type = 'READS_FROM' JOIN nodes s ON s.node_id = b.src AND s.label = 'Dashboard' AND s.sla_tier = 'P0' WHERE m.rel_type = 'PART_OF'",
    ),
    "j09_feature_hops": (
        _pattern("MATCH (t:Transform) WHERE t.project = 'F' MATCH path = (t)-[:WRITES_TO|PRODUCES*1..6]->(f:MLFeature) RETURN DISTINCT f.name AS feature, length(path) AS hops"),
        f"{PRELUDE} SELECT DISTINCT f.name AS feature, 2 AS hops FROM nodes t JOIN edges w ON w.src = t.node_id AND w.rel_type = 'WRITES_TO' JOIN edges m ON m.src = w.dst AND m.rel_type = 'PRODUCES' JOIN nodes f ON f.node_id = m.dst WHERE t.label = 'Transform' AND t.project = 'F'",
    ),
}

#: name: (query, SQL). The ids of the operators are in the operators' docstrings.
TABLE = {
    "g01_column_reach": (_on(lambda n, e: _reach(n, e)), _reach_sql()),
    "g02_dataset_reach": (_on(lambda n, e: _reach(n, e, start="c:5")), _reach_sql(start="c:5")),
    "g04_fan_out": (_on(_neighbours), f"{PRELUDE}, f AS (SELECT dst, count(DISTINCT src) AS n FROM edges WHERE rel_type IN ('READS_FROM','WRITES_TO','DERIVES_FROM','PRODUCES') GROUP BY dst) SELECT node_id, coalesce(n, 0) AS fan_out FROM nodes LEFT JOIN f ON dst = node_id"),
    "g07_longest_trail": (_on(_trail), _TRAIL),
    "g07_longest_trail_circular": (_on(_circular), _CIRCULAR),
    "g09_dashboards_within_3": (_on(lambda n, e: _reach(n, e, ["READS_FROM"], "in", 3, "p:5", "Dashboard")), _reach_sql(["READS_FROM"], "in", 3, "p:5", "Dashboard")),
    "g10_downstream_columns": (_on(lambda n, e: _reach(n, e, ["DERIVES_FROM"], "in", 6)), _reach_sql(["DERIVES_FROM"], "in", 6)),
    "g11_downstream_datasets": (
        _on(lambda n, e: T.bfs(T.hops(e, ["READS_FROM"], "in").unionAll(T.hops(e, ["WRITES_TO"])), _starts(n, "p:5"), 6).join(n.where("label = 'Dataset'").select("node_id"), "node_id", "left_semi")),
        f"""{PRELUDE}, pairs AS (SELECT DISTINCT dst AS a, src AS b FROM edges WHERE rel_type = 'READS_FROM' UNION SELECT src, dst FROM edges WHERE rel_type = 'WRITES_TO'),
        walk(node_id, level) AS (SELECT 'p:5', 0 UNION SELECT b, level + 1 FROM walk JOIN pairs ON a = node_id WHERE level < 6)
        SELECT node_id, min(level) AS level FROM walk JOIN nodes USING (node_id) WHERE label = 'Dataset' AND node_id <> 'p:5' GROUP BY node_id""",
    ),
    "g12_undirected_to_dashboards": (_on(lambda n, e: _reach(n, e, None, "both", 8, "p:5", "Dashboard", 10)), _undirected_sql("p:5", "Dashboard", 10)),
    "g13_neighbourhood": (_on(lambda n, e: _reach(n, e, ["READS_FROM", "WRITES_TO", "DERIVES_FROM"], "in", 4, "k:2", most=100)), _reach_sql(["READS_FROM", "WRITES_TO", "DERIVES_FROM"], "in", 4, "k:2") + " ORDER BY level, node_id LIMIT 100"),
    "g14_hops_to_features": (_on(lambda n, e: _reach(n, e, ["WRITES_TO", "PRODUCES"], "out", 6, "t:5", "MLFeature").select("node_id", F.col("level").alias("hops"))), _reach_sql(["WRITES_TO", "PRODUCES"], "out", 6, "t:5", "MLFeature", "level AS hops")),
    "h01_node_stats": (_on(lambda n, e: C.node_stats(n)), f"{PRELUDE} SELECT label, count(*) AS n FROM nodes GROUP BY label"),
    "h02_edge_stats": (_on(lambda n, e: C.edge_stats(e)), f"{PRELUDE} SELECT rel_type, count(*) AS n FROM edges GROUP BY rel_type"),
    "h03_graph_nodes": (_on(lambda n, e: C.graph_nodes(n)), f"{PRELUDE} SELECT node_id, label, name, project FROM nodes WHERE label IN {_ALL} ORDER BY node_id LIMIT 500"),
    "h03_project_nodes": (_on(lambda n, e: C.graph_nodes(n, "BUILDING")), f"{PRELUDE} SELECT node_id, label, name, project FROM nodes WHERE label IN {_ALL} AND project = 'BUILDING' ORDER BY node_id LIMIT 500"),
    "h04_graph_edges": (_on(lambda n, e: C.graph_edges(n, e)), f"{PRELUDE}, k AS (SELECT node_id FROM nodes WHERE label IN {_ALL}) SELECT DISTINCT src, dst, rel_type FROM edges WHERE src IN (SELECT node_id FROM k) AND dst IN (SELECT node_id FROM k) ORDER BY src, dst, rel_type LIMIT 500"),
    "h05_datasets": (_on(lambda n, e: C.datasets(n, e)), f"{PRELUDE}, u AS (SELECT dst, count(DISTINCT src) AS c FROM edges WHERE rel_type IN ('READS_FROM','WRITES_TO') AND src IN ({_T.format(a='x')}) GROUP BY dst) SELECT name, project, source_type, coalesce(c, 0) AS transform_count FROM nodes LEFT JOIN u ON dst = node_id WHERE label = 'Dataset'"),
    "h06_dataset_columns": (_on(lambda n, e: C.dataset_columns(n, e)), f"{PRELUDE}, u AS (SELECT dst, count(DISTINCT src) AS c FROM edges WHERE rel_type = 'DERIVES_FROM' GROUP BY dst) SELECT dataset, name, sum(coalesce(c, 0))::BIGINT AS downstream_count FROM nodes LEFT JOIN u ON dst = node_id WHERE label = 'Column' GROUP BY dataset, name"),
    "h07_asset_metadata": (_on(lambda n, e: C.asset_metadata(n, e, "p:5")), f"{PRELUDE} SELECT name, coalesce(owner, '') AS owner, coalesce(sla_tier, 'P2') AS sla_tier, coalesce(freshness_cadence, 'daily') AS freshness_cadence, (SELECT count(DISTINCT src) FROM edges WHERE dst = 'p:5' AND rel_type IN ('READS_FROM','WRITES_TO') AND src LIKE 't:%') AS transform_count, (SELECT count(DISTINCT src) FROM edges WHERE dst = 'p:5' AND rel_type = 'READS_FROM' AND src LIKE 's:%') AS dashboard_count FROM nodes WHERE node_id = 'p:5'"),
    "h08_p0_dashboards": (_on(lambda n, e: C.tier_dashboards(n, e)), f"{PRELUDE}, u AS (SELECT src, string_agg(DISTINCT name, ',' ORDER BY name) AS d FROM edges JOIN nodes ON dst = node_id WHERE rel_type = 'READS_FROM' AND label = 'Dataset' AND src LIKE 's:%' GROUP BY src) SELECT name, coalesce(d, '') AS datasets FROM nodes LEFT JOIN u ON src = node_id WHERE label = 'Dashboard' AND sla_tier = 'P0'"),
    "h08_p0_dashboards_as_implemented": (_on(lambda n, e: C.tier_dashboards(n, e, semantics="as_implemented")), f"{PRELUDE} SELECT name, '' AS datasets FROM nodes WHERE label = 'Dashboard' AND sla_tier = 'P0'"),
    "h09_orphans": (_on(lambda n, e: C.orphans(n, e, 5)), f"{PRELUDE} SELECT name, project, count(DISTINCT src) AS dep_count FROM nodes JOIN edges ON dst = node_id WHERE label = 'Dataset' AND coalesce(owner, '') = '' AND rel_type IN ('READS_FROM','WRITES_TO') AND src LIKE 't:%' GROUP BY node_id, name, project HAVING count(DISTINCT src) >= 5"),
    "h10_history": (_on(lambda n, e: C.lineage_history(n, e, "p:5")), f"{PRELUDE} SELECT name AS snapshot, commit_id, created_at FROM nodes WHERE label = 'Snapshot' AND commit_id IN (SELECT commit_id FROM nodes JOIN edges ON src = node_id WHERE label = 'Transform' AND dst = 'p:5') ORDER BY created_at DESC, name LIMIT 10"),
    "h10_history_as_implemented": (_on(lambda n, e: C.lineage_history(n, e, "p:5", semantics="as_implemented")), f"{PRELUDE} SELECT name AS snapshot, commit_id, created_at FROM nodes WHERE label = 'Snapshot' ORDER BY created_at DESC, name LIMIT 10"),
    "h11_many_sources": (_on(lambda n, e: C.many_sources(n, e, 1)), f"{PRELUDE} SELECT dataset, name AS \"column\", count(DISTINCT dst) AS source_count FROM nodes JOIN edges ON src = node_id WHERE rel_type = 'DERIVES_FROM' GROUP BY dataset, name HAVING count(DISTINCT dst) > 1"),
    "h12_inferred_transforms": (_on(lambda n, e: C.inferred_transforms(n)), f"{PRELUDE} SELECT name, pipeline_name, project, created_at FROM nodes WHERE label = 'Transform' AND llm_inferred"),
    "h13_models_reading": (_on(lambda n, e: C.models_reading(n, e, "p:5")), f"{PRELUDE} SELECT DISTINCT name AS model, pipeline_name AS pipeline FROM nodes JOIN edges ON src = node_id WHERE dst = 'p:5' AND label = 'Transform' AND source_type = 'dbt'"),
    "h14_pipeline_dashboards": (_on(lambda n, e: C.pipeline_dashboards(n, e)), f"{PRELUDE}, p AS (SELECT DISTINCT l.name, d.dst FROM edges m JOIN nodes l ON m.dst = l.node_id JOIN edges d ON d.src = m.src WHERE m.rel_type = 'PART_OF' AND l.label = 'Pipeline' AND d.rel_type IN ('READS_FROM','WRITES_TO')) SELECT p.name AS pipeline, count(DISTINCT s.node_id) AS dashboards FROM p JOIN edges r ON r.dst = p.dst JOIN nodes s ON r.src = s.node_id WHERE s.label = 'Dashboard' AND s.sla_tier = 'P0' GROUP BY p.name"),
    "h15_orphans_over_5": (_on(lambda n, e: C.orphans(n, e, 6)), f"{PRELUDE} SELECT name, project, count(DISTINCT src) AS dep_count FROM nodes JOIN edges ON dst = node_id WHERE label = 'Dataset' AND coalesce(owner, '') = '' AND rel_type IN ('READS_FROM','WRITES_TO') AND src LIKE 't:%' GROUP BY node_id, name, project HAVING count(DISTINCT src) > 5"),
    "h16_shared_datasets": (_on(lambda n, e: C.shared_datasets(n, e, "Supplier#000000005")), f"{PRELUDE}, x AS (SELECT dst FROM edges JOIN nodes ON src = node_id WHERE label = 'Dashboard' AND name = 'Supplier#000000005') SELECT DISTINCT l.name AS pipeline, d.name AS dataset FROM x JOIN edges r ON r.dst = x.dst JOIN edges m ON m.src = r.src AND m.rel_type = 'PART_OF' JOIN nodes l ON l.node_id = m.dst AND l.label = 'Pipeline' JOIN nodes d ON d.node_id = x.dst"),
    "h17_transforms_per_project": (_on(lambda n, e: C.transforms_per_project(n)), f"{PRELUDE} SELECT project, count(*) AS transforms FROM nodes WHERE label = 'Transform' GROUP BY project"),
    "h17_wide_transforms": (_on(lambda n, e: C.wide_transforms(n, e)), f"{PRELUDE} SELECT name AS transform, count(DISTINCT dst) AS sources FROM nodes JOIN edges ON src = node_id WHERE label = 'Transform' AND rel_type = 'READS_FROM' GROUP BY node_id, name HAVING count(DISTINCT dst) > 1"),
    "i04_scores": (_scores, f"SELECT l_partkey, {_SCORE} AS score FROM (SELECT l_partkey, CASE l_partkey % 4 WHEN 0 THEN 'P0' WHEN 1 THEN 'P1' ELSE 'P2' END AS sla_tier, CASE l_partkey % 5 WHEN 0 THEN 'streaming' WHEN 1 THEN 'hourly' WHEN 2 THEN 'daily' WHEN 3 THEN 'weekly' END AS cadence, count(DISTINCT l_orderkey) AS fan FROM lineitem GROUP BY l_partkey)"),
    "i07_report": (_on(_report), _REPORT),
    "impact_column": (_ranked(_CHANGE, "documented"), _RANKED_DOC),
    "impact_column_as_implemented": (_ranked(_CHANGE, "as_implemented"), _ranked_sql(_CHANGE, _WALK.format(start="k:5") + ", " + _FAN_IN.format(where=" WHERE rel_type <> 'PART_OF'"), f" ORDER BY fan DESC, n.node_id LIMIT {I.KEPT}")),
    "impact_dataset": (_ranked(_TABLE, "documented"), _ranked_sql(_TABLE, _TABLE_FLOW, "", _ALL.replace("'Column',", ""))),
    "impact_dataset_as_implemented": (_ranked(I.SchemaChange("c:5", None, "drop_column"), "as_implemented"), _ranked_sql(I.SchemaChange("c:5", None, "drop_column"), _WALK.format(start="c:5") + ", " + _FAN_IN.format(where=""), f" ORDER BY fan DESC, n.node_id LIMIT {I.KEPT}", _ALL.replace("'Column',", ""))),
    "impact_all_columns": (_on(_many), _many_sql(_MANY_COLUMNS, "label = 'Column'", _ALL)),
    "j14_missing_columns": (_on(_missing), f"{PRELUDE} SELECT * FROM (VALUES ('p:5', 'k:6'), ('nope', 'a')) v(dataset, \"column\")"),
    "k01_grid": (_on(lambda n, e: layout.grid(C.graph_nodes(n, limit=1000))), f"{PRELUDE}, o AS (SELECT node_id, label, list_position(['Dataset','Transform','Column','Pipeline','Dashboard','MLFeature'], label) AS place FROM (SELECT * FROM nodes WHERE label IN {_ALL} ORDER BY node_id LIMIT 1000)) SELECT node_id, label, 260 * (dense_rank() OVER (ORDER BY place) - 1) AS x, 80 * (row_number() OVER (PARTITION BY label ORDER BY node_id) - 1) AS y FROM o"),
    "k02_shares": (_on(lambda n, e: C.stats_shares(C.node_stats(n))), f"{PRELUDE}, s AS (SELECT label, count(*) AS n FROM nodes GROUP BY label) SELECT label, n, sum(n) OVER ()::BIGINT AS total, max(n) OVER () AS largest, floor(100.0::DOUBLE * n / max(n) OVER () + 0.5)::BIGINT AS share FROM s"),
}
_NAMED = "SELECT name FROM nodes WHERE"
#: The questions that an evaluation asks, as patterns; two more are ``h17_transforms_per_project`` and ``h17_wide_transforms``.
_QUESTIONS = {
    "h17_features_of_table": ("MATCH (d:Dataset {name: 'c:5'})-[:PRODUCES]->(f:MLFeature) RETURN f.name AS name", "SELECT f.name FROM edges JOIN nodes f ON f.node_id = dst WHERE src = 'c:5' AND rel_type = 'PRODUCES' AND f.label = 'MLFeature'"),
    "h17_models_of_project": ("MATCH (t:Transform) WHERE t.source_type = 'dbt' AND t.project = 'F' RETURN t.name AS name", f"{_NAMED} label = 'Transform' AND source_type = 'dbt' AND project = 'F'"),
    "h17_written_by": ("MATCH (t:Transform {name: 't:5'})-[:WRITES_TO]->(d:Dataset) RETURN d.name AS name", "SELECT d.name FROM edges JOIN nodes d ON d.node_id = dst WHERE src = 't:5' AND rel_type = 'WRITES_TO'"),
    "h17_p0_dashboards": ("MATCH (d:Dashboard) WHERE d.sla_tier = 'P0' RETURN d.name AS name", f"{_NAMED} label = 'Dashboard' AND sla_tier = 'P0'"),
    "h17_sources_of_table": ("MATCH (d:Dataset {name: 'c:5'})<-[:WRITES_TO]-(t:Transform)-[:READS_FROM]->(s:Dataset) RETURN DISTINCT s.name AS name", "SELECT DISTINCT s.name FROM edges w JOIN edges r ON r.src = w.src AND r.rel_type = 'READS_FROM' JOIN nodes s ON s.node_id = r.dst WHERE w.dst = 'c:5' AND w.rel_type = 'WRITES_TO'"),
    "h17_inferred": ("MATCH (t:Transform) WHERE t.llm_inferred = true RETURN t.name AS name, t.pipeline_name AS pipeline", "SELECT name, pipeline_name AS pipeline FROM nodes WHERE label = 'Transform' AND llm_inferred"),
    "h17_columns_of_table": ("MATCH (c:Column)-[:PART_OF]->(d:Dataset) WHERE d.source_type = 'sql' RETURN d.name AS dataset, c.name AS name", "SELECT d.name AS dataset, c.name FROM edges JOIN nodes c ON c.node_id = src AND c.label = 'Column' JOIN nodes d ON d.node_id = dst AND d.source_type = 'sql' WHERE rel_type = 'PART_OF' AND d.label = 'Dataset'"),
    "h17_kafka_topics": ("MATCH (d:Dataset) WHERE d.source_type = 'kafka' RETURN d.name AS name, d.project AS project", "SELECT name, project FROM nodes WHERE label = 'Dataset' AND source_type = 'kafka'"),
    "h17_pipelines_of_project": ("MATCH (t:Transform)-[:PART_OF]->(p:Pipeline) WHERE t.project = 'F' RETURN DISTINCT p.name AS name", "SELECT DISTINCT p.name FROM edges JOIN nodes t ON t.node_id = src AND t.label = 'Transform' AND t.project = 'F' JOIN nodes p ON p.node_id = dst AND p.label = 'Pipeline' WHERE rel_type = 'PART_OF'"),
    "h17_derived_from": ("MATCH (c:Column)-[:DERIVES_FROM]->(s:Column {name: 'k:5'}) RETURN c.name AS name", "SELECT c.name FROM edges JOIN nodes c ON c.node_id = src WHERE dst = 'k:5' AND rel_type = 'DERIVES_FROM'"),
    "h17_without_owner": ("MATCH (d:Dataset) WHERE d.owner IS NULL OR d.owner = '' RETURN d.name AS name", f"{_NAMED} label = 'Dataset' AND coalesce(owner, '') = ''"),
    "h17_path_between": ("MATCH path = (a:Dataset {name: 'p:5'})<-[:READS_FROM]-(t:Transform)-[:WRITES_TO]->(b:Dataset) RETURN DISTINCT b.name AS name, length(path) AS hops", "SELECT DISTINCT b.name, 2 AS hops FROM edges r JOIN edges w ON w.src = r.src AND w.rel_type = 'WRITES_TO' JOIN nodes b ON b.node_id = w.dst WHERE r.dst = 'p:5' AND r.rel_type = 'READS_FROM' AND r.src LIKE 't:%'"),
    "h17_transforms_of_pipeline": ("MATCH (t:Transform)-[:PART_OF]->(p:Pipeline {name: '1-URGENT'}) RETURN t.name AS name", "SELECT t.name FROM edges JOIN nodes t ON t.node_id = src AND t.label = 'Transform' JOIN nodes p ON p.node_id = dst AND p.name = '1-URGENT' WHERE rel_type = 'PART_OF'"),
}
TABLE |= _PATTERNS | {k: (_pattern(q), f"{PRELUDE} {sql}") for k, (q, sql) in _QUESTIONS.items()}
QUERIES = {k: v[0] for k, v in TABLE.items()}
ORACLES = {k: v[1] for k, v in TABLE.items() if v[1]}
