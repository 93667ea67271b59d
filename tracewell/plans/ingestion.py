"""The ingestion queries over the driver's tables, with their DuckDB SQL.

Orders make lineage events, parts make registry subjects, suppliers make dbt manifests and orders again
change envelopes; both engines compute them with the same expressions. Parts make SQL texts and orders
make plans in ``sql_queries`` and ``plan_queries``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.model import normalise
from tracewell.operators import upsert as U
from tracewell.plans import plan_queries, sql_queries
from tracewell.sources import dbt, registry
from tracewell.streaming.cdc import ENVELOPE, routed

_DAY = "1995-06-17"

#: Columns of an event that both engines write alike.
_PLAIN = {
    "event_id": "concat('e', o_orderkey)",
    "source_type": "CASE o_orderkey % 4 WHEN 0 THEN 'dbt' WHEN 1 THEN 'spark' WHEN 2 THEN 'sql' ELSE 'kafka' END",
    "project_name": "o_orderpriority",
    "commit_id": "CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('m', o_orderkey % 50) END",
    "transform_id": "concat('t', o_custkey % 300)",
    "transform_name": "concat('n', o_orderkey % 97)",
    "pipeline_name": "CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('l', o_custkey % 20) END",
    "raw_sql": "concat('select ', o_orderkey)",
    "validation_status": "CASE o_orderkey % 9 WHEN 0 THEN 'flagged' ELSE 'ok' END",
}
_S1, _S2, _T1 = "concat('d', o_custkey % 40)", "concat('d', o_orderkey % 25)", "concat('d', 30 + o_orderkey % 23)"
_C1, _C2, _C3, _C4 = (f"concat('c', o_orderkey % {n})" for n in (9, 5, 4, 7))
_X1 = "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('f', o_orderkey) END"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event for each order, of which a tenth come twice; some lists are empty or null."""
    ref = lambda d, c: f"named_struct('dataset', {d}, 'column', {c}, 'warehouse', 'generic')"
    d1 = f"named_struct('source', {ref(_S1, _C1)}, 'target', {ref(_T1, _C2)}, 'expression', {_X1}, 'is_passthrough', o_orderkey % 3 = 0)"
    d2 = f"named_struct('source', {ref(_S2, _C3)}, 'target', {ref(_T1, _C4)}, 'expression', cast(null as string), 'is_passthrough', true)"
    lists = [
        "cast(o_orderdate as timestamp) AS ingested_at", f"array({_S1}, {_S2}) AS source_datasets", f"CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE array({_T1}) END AS target_datasets",
        f"CASE WHEN o_orderkey % 6 = 0 THEN slice(array({d1}), 1, 0) ELSE array({d1}, {d2}) END AS column_derivations", "cast(null as string) AS tags", "o_orderkey % 11 = 0 AS llm_inferred",
    ]
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(*[f"{x} AS {c}" for c, x in _PLAIN.items()], *lists)
    return rows.unionAll(rows.where("cast(substr(event_id, 2) as long) % 10 = 0"))


_EV = f"""WITH ev AS (SELECT {', '.join(f'{x} AS {c}' for c, x in _PLAIN.items())}, o_orderdate::TIMESTAMP AS ts, o_orderkey AS k, o_orderkey % 11 = 0 AS llm_inferred,
    {_S1} AS s1, {_S2} AS s2, {_T1} AS t1, {_C1} AS c1, {_C2} AS c2, {_C3} AS c3, {_C4} AS c4, {_X1} AS x1 FROM orders),
    e AS (SELECT *, coalesce(nullif(commit_id, ''), event_id) AS cm FROM ev),
    ds AS (SELECT project_name AS project, s1 AS name, source_type, cm, ts, event_id, 0 AS p FROM e UNION ALL SELECT project_name, s2, source_type, cm, ts, event_id, 1 FROM e
        UNION ALL SELECT project_name, t1, source_type, cm, ts, event_id, 2 FROM e WHERE k % 13 <> 0),
    dv AS (SELECT project_name AS project, s1 AS sd, c1 AS sc, t1 AS td, c2 AS tc, x1 AS expression, k % 3 = 0 AS is_passthrough, transform_id, cm, ts, event_id, 0 AS p FROM e WHERE k % 6 <> 0
        UNION ALL SELECT project_name, s2, c3, t1, c4, NULL, true, transform_id, cm, ts, event_id, 1 FROM e WHERE k % 6 <> 0),
    cl AS (SELECT project, sd AS dataset, sc AS name, cm, ts, event_id, p * 2 AS p FROM dv UNION ALL SELECT project, td, tc, cm, ts, event_id, p * 2 + 1 FROM dv)"""
_ORDER = "ORDER BY ts, event_id, p"
_SEEN = "min(ts)::DATE::VARCHAR AS created, CASE WHEN count(*) > 1 THEN max(ts)::DATE::VARCHAR END AS seen"


def _days() -> list:
    return [F.col("created_at").cast("date").cast("string").alias("created"), F.col("last_seen_at").cast("date").cast("string").alias("seen")]


def _id(label: str, *key: str) -> str:
    return f"sha256(to_json(['{label}', {', '.join(key)}])::VARCHAR)"


def _ev(build):
    return lambda spark, sf_dir: build(U.prepared(events(spark, sf_dir)))


def _replay(spark, sf_dir, **options):
    nodes, edges = U.replay(events(spark, sf_dir), **options)
    return nodes.groupBy(F.col("label").alias("kind")).agg(F.count(F.lit(1)).alias("n")).unionAll(edges.groupBy("rel_type").agg(F.count(F.lit(1))))


def _kinds(where: str = "") -> str:
    """Counts of nodes by label and of edges by type of the events that ``where`` leaves."""
    ev = _EV.replace("AS cm FROM ev)", f"AS cm FROM ev {where})")
    return f"""{ev}, known AS (SELECT DISTINCT project, name FROM ds), pl AS (SELECT DISTINCT project_name, pipeline_name FROM e WHERE coalesce(pipeline_name, '') <> '')
    SELECT 'Dataset' AS kind, count(*) AS n FROM known UNION ALL SELECT 'Column', count(*) FROM (SELECT DISTINCT project, dataset, name FROM cl)
    UNION ALL SELECT 'Transform', count(DISTINCT transform_id) FROM e UNION ALL SELECT 'Pipeline', count(*) FROM pl UNION ALL SELECT 'Snapshot', count(*) FROM e
    UNION ALL SELECT 'READS_FROM', count(*) FROM (SELECT DISTINCT transform_id, project_name, s1 AS d, cm FROM e UNION SELECT transform_id, project_name, s2, cm FROM e)
    UNION ALL SELECT 'WRITES_TO', count(*) FROM (SELECT DISTINCT transform_id, project_name, t1, cm FROM e WHERE k % 13 <> 0)
    UNION ALL SELECT 'DERIVES_FROM', count(*) FROM (SELECT DISTINCT project, td, tc, sd, sc FROM dv)
    UNION ALL SELECT 'PART_OF', (SELECT count(*) FROM (SELECT DISTINCT c.project, c.dataset, c.name FROM cl c JOIN known d ON c.project = d.project AND c.dataset = d.name))
        + (SELECT count(*) FROM (SELECT DISTINCT transform_id, project_name, pipeline_name FROM e WHERE coalesce(pipeline_name, '') <> ''))"""


def _stored(spark, sf_dir) -> U.GraphStore:
    """Two batches in the order of time, the second tried twice."""
    store, ev = U.GraphStore(spark), events(spark, sf_dir)
    store.apply(ev.where(f"ingested_at < '{_DAY}'"), "a")
    for _ in range(2):
        store.apply(ev.where(f"ingested_at >= '{_DAY}'"), "b")
    return store


def _counts(spark, sf_dir):
    s = _stored(spark, sf_dir)
    return s.nodes().groupBy(F.col("label").alias("kind")).agg(F.count(F.lit(1)).alias("n")).unionAll(s.edges().groupBy("rel_type").agg(F.count(F.lit(1))))


def _scan(spark, sf_dir):
    return _stored(spark, sf_dir).nodes().where("label = 'Dataset' and name = 'd31'").select("project", "name", "source_type", "commit_id", *_days())


_DATASETS = f"{_EV} SELECT project, name, first(source_type {_ORDER}) AS source_type, last(cm {_ORDER}) AS commit_id, {_SEEN} FROM ds GROUP BY project, name"
_T_FIRST = ["transform_name AS name", "project_name AS project", "pipeline_name", "source_type", "llm_inferred", "validation_status", "raw_sql"]

_B = {
    "b01_datasets": (_ev(lambda e: U.datasets(e).select("project", "name", "source_type", "commit_id", *_days())), _DATASETS),
    "b02_transforms": (
        _ev(lambda e: U.transforms(e).select("transform_id", "name", "project", "pipeline_name", "source_type", "llm_inferred", "validation_status", "raw_sql", "commit_id", *_days())),
        f"{_EV} SELECT transform_id, {', '.join(f'first({x.split()[0]} ORDER BY ts, event_id) AS {x.split()[-1]}' for x in _T_FIRST)}, last(cm ORDER BY ts, event_id) AS commit_id, {_SEEN} FROM e GROUP BY transform_id",
    ),
    "b03_reads": (
        _ev(lambda e: U.reads_writes(e).where("rel_type = 'READS_FROM'").select("src", "dst", "commit_id", F.col("created_at").cast("date").cast("string").alias("created"))),
        f"{_EV}, r AS (SELECT transform_id, project_name, s1 AS d, cm, ts FROM e UNION ALL SELECT transform_id, project_name, s2, cm, ts FROM e) SELECT {_id('Transform', 'transform_id')} AS src, {_id('Dataset', 'project_name', 'd')} AS dst, cm AS commit_id, min(ts)::DATE::VARCHAR AS created FROM r GROUP BY ALL",
    ),
    "b04_writes": (
        _ev(lambda e: U.reads_writes(e).where("rel_type = 'WRITES_TO'").select("src", "dst", "commit_id", F.col("created_at").cast("date").cast("string").alias("created"))),
        f"{_EV} SELECT {_id('Transform', 'transform_id')} AS src, {_id('Dataset', 'project_name', 't1')} AS dst, cm AS commit_id, min(ts)::DATE::VARCHAR AS created FROM e WHERE k % 13 <> 0 GROUP BY ALL",
    ),
    "b05_columns": (_ev(lambda e: U.columns(e).select("project", "dataset", "name", "commit_id", *_days())), f"{_EV} SELECT project, dataset, name, last(cm {_ORDER}) AS commit_id, {_SEEN} FROM cl GROUP BY project, dataset, name"),
    "b06_memberships": (
        _ev(lambda e: U.memberships(e).select("src", "dst")),
        f"{_EV} SELECT DISTINCT {_id('Column', 'c.project', 'c.dataset', 'c.name')} AS src, {_id('Dataset', 'c.project', 'c.dataset')} AS dst FROM cl c JOIN ds ON c.project = ds.project AND c.dataset = ds.name UNION SELECT {_id('Transform', 'transform_id')}, {_id('Pipeline', 'project_name', 'pipeline_name')} FROM e WHERE coalesce(pipeline_name, '') <> ''",
    ),
    "b06_memberships_as_implemented": (
        _ev(lambda e: U.memberships(e, "as_implemented").select("src", "dst")),
        f"{_EV} SELECT DISTINCT {_id('Column', 'c.project', 'c.sd', 'c.sc')} AS src, {_id('Dataset', 'c.project', 'c.sd')} AS dst FROM dv c JOIN ds ON c.project = ds.project AND c.sd = ds.name UNION SELECT {_id('Transform', 'transform_id')}, {_id('Pipeline', 'project_name', 'pipeline_name')} FROM e WHERE coalesce(pipeline_name, '') <> ''",
    ),
    "b07_derivations": (
        _ev(lambda e: U.derivations(e).select("src", "dst", "transform_id", "is_passthrough", "expression", "commit_id", *_days())),
        f"{_EV} SELECT {_id('Column', 'project', 'td', 'tc')} AS src, {_id('Column', 'project', 'sd', 'sc')} AS dst, first(transform_id {_ORDER}) AS transform_id, first(is_passthrough {_ORDER}) AS is_passthrough, last(expression {_ORDER}) AS expression, last(cm {_ORDER}) AS commit_id, {_SEEN} FROM dv GROUP BY project, td, tc, sd, sc",
    ),
    "b08_pipelines": (_ev(lambda e: U.pipelines(e).select("project", "name", "source_type", *_days())), f"{_EV} SELECT project_name AS project, pipeline_name AS name, first(source_type ORDER BY ts, event_id) AS source_type, {_SEEN} FROM e WHERE coalesce(pipeline_name, '') <> '' GROUP BY ALL"),
    "b09_snapshots": (_ev(lambda e: U.snapshots(e).select("name", "commit_id", "project", "source_type")), f"{_EV} SELECT concat(cm, '_', event_id) AS name, cm AS commit_id, project_name AS project, source_type FROM e"),
    "b10_commits": (_ev(lambda e: e.select("event_id", F.col("commit").alias("commit_id"))), f"{_EV} SELECT event_id, cm AS commit_id FROM e"),
    "b11_write_stats": (_ev(U.write_stats), f"{_EV} SELECT event_id, (3 + (k % 13 <> 0)::INT)::BIGINT AS node_count, (2 + (k % 13 <> 0)::INT + CASE WHEN k % 6 = 0 THEN 0 ELSE 2 END)::BIGINT AS rel_count FROM e"),
    "b12_store": (_counts, _kinds()),
    "b14_retried_batch": (lambda s, d: s.createDataFrame([(n, b) for n, b in _stored(s, d).versions()], "version int, batch string"), "SELECT * FROM (VALUES (1, 'a'), (2, 'b')) v(version, batch)"),
    "b16_replay_commit": (lambda s, d: _replay(s, d, commit="m9"), _kinds("WHERE coalesce(nullif(commit_id, ''), event_id) = 'm9'")),
    "b16_replay_until": (lambda s, d: _replay(s, d, until=_DAY), _kinds(f"WHERE ts <= '{_DAY}'")),
    "a05_stored_graph": (lambda s, d: _stored(s, d).nodes().where("label = 'Dataset'").select("project", "name", "source_type", "commit_id", *_days()), _DATASETS),
    "a06_label_scan": (_scan, f"SELECT * FROM ({_DATASETS}) WHERE name = 'd31'"),
}


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry subject for each part; a quarter are of a kind that has no columns."""
    avro = """concat('{"type": "record", "name": "r", "fields": [{"name": "id', p_partkey, '", "type": "', CASE p_size % 3 WHEN 0 THEN 'int' WHEN 1 THEN 'long' ELSE 'bytes' END, '"}, {"name": "opt", "type": ["null", "double"], "doc": "d', p_size, '"}, {"name": "tree", "type": {"type": "array", "items": "string"}}]}')"""
    plain = """concat('{"properties": {"n', p_size, '": {"type": "number", "description": "x"}, "free": {"type": ["null", "string"]}}, "required": ["n', p_size, '"]}')"""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    return rows.selectExpr("concat('s', p_partkey, CASE p_partkey % 3 WHEN 0 THEN '-value' WHEN 1 THEN '-key' ELSE '' END) AS subject", "cast(p_size as int) AS version", "CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'AVRO' WHEN 2 THEN 'JSON' ELSE 'PROTOBUF' END AS schemaType", f"CASE WHEN p_partkey % 4 < 2 THEN {avro} WHEN p_partkey % 4 = 2 THEN {plain} ELSE 'syntax = 3' END AS schema")


_SUBJECT = "concat('s', p_partkey, CASE p_partkey % 3 WHEN 0 THEN '-value' WHEN 1 THEN '-key' ELSE '' END)"
_FIELDS = f"""SELECT {_SUBJECT} AS subject, p_size::INT AS version, 0 AS pos, concat('id', p_partkey) AS name, CASE p_size % 3 WHEN 0 THEN 'integer' WHEN 1 THEN 'bigint' ELSE 'bytes' END AS type, false AS nullable, NULL AS doc FROM part WHERE p_partkey % 4 < 2
    UNION ALL SELECT {_SUBJECT}, p_size::INT, 1, 'opt', 'double', true, concat('d', p_size) FROM part WHERE p_partkey % 4 < 2
    UNION ALL SELECT {_SUBJECT}, p_size::INT, 2, 'tree', 'array', false, NULL FROM part WHERE p_partkey % 4 < 2
    UNION ALL SELECT {_SUBJECT}, p_size::INT, 0, concat('n', p_size), 'number', false, 'x' FROM part WHERE p_partkey % 4 = 2
    UNION ALL SELECT {_SUBJECT}, p_size::INT, 1, 'free', 'string', true, NULL FROM part WHERE p_partkey % 4 = 2"""
_TOPIC = "concat('s', p_partkey)"

_F = {
    "f01_names": (lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", normalise(F.concat(F.lit(' \t"`'), "p_name", F.lit('`" \n'))).alias("name"), normalise(F.concat(F.lit('`"'), "p_name", F.lit('"`'))).alias("inner_quotes")), "SELECT p_partkey, p_name AS name, concat('\"', p_name, '\"') AS inner_quotes FROM part"),
    "f03_topics": (lambda s, d: subjects(s, d).select("subject", registry.topic(F.col("subject")).alias("topic")), f"SELECT {_SUBJECT} AS subject, {_TOPIC} AS topic FROM part"),
    "f04_subject_columns": (lambda s, d: registry.subject_columns(subjects(s, d)), _FIELDS),
    "f05_avro_types": (lambda s, d: registry.subject_columns(subjects(s, d)).groupBy("type").agg(F.count(F.lit(1)).alias("n")), f"SELECT type, count(*) AS n FROM ({_FIELDS}) GROUP BY type"),
    "f06_nullable": (lambda s, d: registry.subject_columns(subjects(s, d)).where("nullable").select("subject", "name"), f"SELECT subject, name FROM ({_FIELDS}) WHERE nullable"),
    "f02_filtered_topics": (lambda s, d: registry.events(subjects(s, d), "p", topics="^s1").select("transform_id", F.col("target_datasets")[0].alias("target")), f"SELECT concat('kafka_schema_', {_SUBJECT}, '_', p_size) AS transform_id, concat('kafka.', {_TOPIC}) AS target FROM part WHERE p_partkey % 4 <> 3 AND {_TOPIC} LIKE 's1%'"),
    "f07_events_as_implemented": (
        lambda s, d: registry.events(subjects(s, d), "p", commit="c", semantics="as_implemented").select("event_id", F.explode("column_derivations").alias("d")).select("event_id", F.col("d.source.dataset").alias("dataset"), F.col("d.source.column").alias("column"), F.col("d.target.column").alias("target"), F.col("d.is_passthrough").alias("is_passthrough")),
        f"SELECT concat('kafka_schema_', subject, '_', version, '@p') AS event_id, concat('kafka.', regexp_replace(subject, '-(value|key)$', '')) AS dataset, name AS \"column\", name AS target, true AS is_passthrough FROM ({_FIELDS})",
    ),
}


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest for each nation, with a node for each of its suppliers; the first holds the sources."""
    node = """named_struct('name', concat('s', s_suppkey), 'alias', CASE WHEN s_suppkey % 3 = 0 THEN concat('a', s_suppkey) END, 'schema', CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('sc', s_nationkey) END,
        'resource_type', CASE s_suppkey % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'snapshot' WHEN 2 THEN 'seed' ELSE 'model' END, 'package_name', 'p', 'fqn', array(concat('pk', s_nationkey), 'x'),
        'config', named_struct('materialized', 'table', 'enabled', CASE s_suppkey % 6 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END),
        'depends_on', named_struct('nodes', CASE WHEN s_suppkey % 8 = 0 THEN NULL ELSE array(concat('model.', s_suppkey + 1), concat('source.', s_suppkey % 10), 'model.gone') END),
        'compiled_sql', CASE s_suppkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('select ', s_suppkey) END, 'compiled_code', concat('code ', s_suppkey),
        'columns', map('c', named_struct('name', concat('c', s_suppkey))), 'tags', cast(array() as array<string>))"""
    own = spark.read.parquet(f"{sf_dir}/supplier.parquet").groupBy("s_nationkey").agg(F.map_from_entries(F.collect_list(F.struct(F.expr("concat('model.', s_suppkey)"), F.expr(node)))).alias("nodes"))
    sources = "map_from_entries(transform(sequence(0, 9), i -> struct(concat('source.', i), named_struct('name', concat('t', i), 'source_name', 'raw', 'resource_type', 'source'))))"
    least = spark.read.parquet(f"{sf_dir}/supplier.parquet").agg(F.min("s_nationkey").alias("least"))
    return own.crossJoin(F.broadcast(least)).selectExpr("nodes", f"CASE WHEN s_nationkey = least THEN {sources} ELSE map_from_entries(slice(array(struct('', named_struct('name', '', 'source_name', '', 'resource_type', ''))), 1, 0)) END AS sources")


_NAME = "CASE WHEN s_suppkey % 4 < 2 THEN '' ELSE concat('sc', s_nationkey, '.') END || CASE WHEN s_suppkey % 3 = 0 THEN concat('a', s_suppkey) ELSE concat('s', s_suppkey) END"
_MODELS = f"""WITH n AS (SELECT s_suppkey AS k, s_nationkey, {_NAME} AS name FROM supplier),
    m AS (SELECT n.*, CASE WHEN k % 8 = 0 THEN '' ELSE coalesce((SELECT x.name || ',' FROM n x WHERE x.k = n.k + 1), '') || 'raw.t' || (k % 10) END AS deps, CASE k % 7 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('select ', k) END AS csql FROM n WHERE k % 5 <> 0 AND k % 6 <> 0)
    SELECT concat('model.', k) AS "key", name AS target, deps, coalesce(nullif(csql, ''), concat('code ', k)) AS sql, concat('c', k) AS columns, concat('pk', s_nationkey) AS pipeline FROM m WHERE deps <> '' OR coalesce(csql, '') <> ''"""


def _models(spark, sf_dir):
    return dbt.models(manifests(spark, sf_dir)).select("key", "target", F.array_join("deps", ",").alias("deps"), "sql", F.array_join("columns", ",").alias("columns"), "pipeline")


def _compiled(spark, sf_dir):
    """Every second model has SQL over its first dependency instead of its own."""
    own = dbt.models(manifests(spark, sf_dir))
    return own.withColumn("sql", F.expr("CASE WHEN size(deps) > 0 AND cast(substr(key, 7) AS int) % 2 = 0 THEN concat('WITH base AS (SELECT id, v * 2 AS w FROM ', deps[0], ') SELECT base.w, base.id AS ', 'k', substr(key, 7), ' FROM base -- of ', key) ELSE sql END"))


_COMPILED = f"""SELECT "key", target, CASE WHEN even THEN unnest(['w', 'k' || "key"[7:]]) ELSE columns END AS "column", string_split(deps, ',')[1] AS source_dataset, CASE WHEN even THEN unnest(['v', 'id']) ELSE columns END AS source_column,
    CASE WHEN even THEN unnest([false, true]) ELSE true END AS is_passthrough FROM (SELECT *, "key"[7:]::INT % 2 = 0 AS even FROM ({_MODELS}) WHERE deps <> '')"""
_COMPILED = f"SELECT DISTINCT * FROM ({_COMPILED})"


_D = {
    "d06_compiled_lineage": (lambda s, d: dbt.lineage(_compiled(s, d)), _COMPILED),
    "d07_declared_columns": (lambda s, d: dbt.lineage(dbt.models(manifests(s, d))), f"""SELECT "key", target, columns AS "column", string_split(deps, ',')[1] AS source_dataset, columns AS source_column, true AS is_passthrough FROM ({_MODELS}) WHERE deps <> ''"""),
    "d09_tags": (lambda s, d: dbt.models(manifests(s, d)).select("key", F.get_json_object("tags", "$.resource_type").alias("kind"), F.get_json_object("tags", "$.materialized").alias("materialized"), F.get_json_object("tags", "$.package").alias("package")), f"""SELECT "key", CASE "key"[7:]::INT % 5 WHEN 1 THEN 'snapshot' WHEN 2 THEN 'seed' ELSE 'model' END AS kind, 'table' AS materialized, 'p' AS package FROM ({_MODELS})"""),
    "d01_models": (_models, _MODELS),
    "d03_names": (lambda s, d: _models(s, d).select("key", "target"), f'SELECT "key", target FROM ({_MODELS})'),
    "d04_dependencies": (lambda s, d: _models(s, d).where("deps <> ''").select("key", F.explode(F.split("deps", ",")).alias("dep")), f'SELECT "key", unnest(string_split(deps, \',\')) AS dep FROM ({_MODELS}) WHERE deps <> \'\''),
    "d08_pipelines": (lambda s, d: _models(s, d).groupBy("pipeline").agg(F.count(F.lit(1)).alias("n")), f"SELECT pipeline, count(*) AS n FROM ({_MODELS}) GROUP BY pipeline"),
    "l01_routed_changes": (
        lambda s, d: routed(s.read.parquet(f"{d}/orders.parquet").select(F.from_json(F.expr("""concat('{"op": "', CASE o_orderkey % 3 WHEN 0 THEN 'd' ELSE 'c' END, '", "ts_ms": ', o_orderkey * 1000, ', "source": {"table": ', CASE WHEN o_orderkey % 5 = 0 THEN 'null' ELSE concat('"t', o_custkey, '"') END, '}, "after": ', CASE o_orderkey % 3 WHEN 0 THEN 'null' WHEN 1 THEN concat('{"ddl": "alter table x drop column c', o_custkey, '"}') ELSE concat('{"dataset": "d', o_custkey, '", "column": "c"}') END, '}')"""), ENVELOPE).alias("e")).select("e.*")).select("op", F.unix_millis("at").alias("ms"), "dataset", "column", "ddl", "is_alter"),
        "SELECT CASE o_orderkey % 3 WHEN 0 THEN 'd' ELSE 'c' END AS op, (o_orderkey * 1000)::BIGINT AS ms, CASE WHEN o_orderkey % 3 = 2 THEN concat('d', o_custkey) WHEN o_orderkey % 5 = 0 THEN 'unknown' ELSE concat('t', o_custkey) END AS dataset, CASE WHEN o_orderkey % 3 = 2 THEN 'c' END AS \"column\", CASE WHEN o_orderkey % 3 = 1 THEN concat('alter table x drop column c', o_custkey) END AS ddl, o_orderkey % 3 = 1 AS is_alter FROM orders",
    ),
}


TABLE = _B | _F | _D | sql_queries.TABLE | plan_queries.TABLE
QUERIES = {k: v[0] for k, v in TABLE.items()}
ORACLES = {k: v[1] for k, v in TABLE.items()}
