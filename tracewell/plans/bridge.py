"""A lineage graph made of the driver's tables, and the same graph as a SQL prelude."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SLA = "CASE {k} % 3 WHEN 0 THEN 'P0' WHEN 1 THEN 'P1' ELSE 'P2' END"
_CADENCE = "CASE {k} % 4 WHEN 0 THEN 'streaming' WHEN 1 THEN 'hourly' WHEN 2 THEN 'daily' ELSE 'weekly' END"
_SOURCE = "CASE {k} % 4 WHEN 0 THEN 'dbt' WHEN 1 THEN 'spark' WHEN 2 THEN 'sql' ELSE 'kafka' END"
_COLS = ["node_id", "label", "project", "dataset", "name", "transform_id", "pipeline_name", "source_type", "owner", "sla_tier", "freshness_cadence", "llm_inferred", "commit_id", "created_at"]


def _node(table: str, where: str = "", distinct: bool = False, **given: str) -> str:
    cols = ", ".join(f"{given.get(c, 'CAST(NULL AS BOOLEAN)' if c == 'llm_inferred' else 'CAST(NULL AS TIMESTAMP)' if c == 'created_at' else 'CAST(NULL AS VARCHAR(99))')} AS {c}" for c in _COLS)
    return f"SELECT {'DISTINCT ' if distinct else ''}{cols} FROM {table} {where}"


def _sql(div: str, month: str) -> tuple[str, str]:
    """nodes and edges; the engines differ in integer division and in formatting a month."""
    commit = month.format("o_orderdate")
    nodes = " UNION ALL ".join([
        _node("part", node_id="concat('p:', p_partkey)", label="'Dataset'", project="p_brand", name="concat('p:', p_partkey)", source_type=_SOURCE.format(k="p_partkey"), owner="CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE p_type END"),
        _node("customer", node_id="concat('c:', c_custkey)", label="'Dataset'", project="c_mktsegment", name="concat('c:', c_custkey)", source_type="'manual'", owner="c_name"),
        _node("orders", node_id="concat('t:', o_orderkey)", label="'Transform'", project="o_orderstatus", name="concat('t:', o_orderkey)", transform_id="concat('t:', o_orderkey)", pipeline_name="o_orderpriority", source_type=_SOURCE.format(k="o_orderkey"), llm_inferred="o_orderkey % 17 = 0", commit_id=commit, created_at="o_orderdate"),
        _node("orders", distinct=True, node_id="concat('l:', o_orderpriority)", label="'Pipeline'", name="o_orderpriority"),
        _node("part", node_id="concat('k:', p_partkey)", label="'Column'", project="p_brand", dataset="concat('p:', p_partkey)", name="concat('k:', p_partkey)"),
        _node("supplier", node_id="concat('s:', s_suppkey)", label="'Dashboard'", name="s_name", sla_tier=_SLA.format(k="s_nationkey"), freshness_cadence=_CADENCE.format(k="s_suppkey")),
        _node("nation", node_id="concat('n:', n_nationkey)", label="'MLFeature'", name="n_name", sla_tier=_SLA.format(k="n_nationkey"), freshness_cadence="'weekly'"),
        _node("orders", "WHERE o_orderkey % 100 = 0", node_id="concat('x:', o_orderkey)", label="'Snapshot'", project="o_orderstatus", name="concat('x:', o_orderkey)", commit_id=commit, created_at="o_orderdate"),
    ])
    derive = lambda n, where: f"SELECT concat('k:', p_partkey) AS src, concat('k:', {div.format('p_partkey', n)}) AS dst, 'DERIVES_FROM' AS rel_type, concat('t:', p_partkey) AS transform_id FROM part WHERE {where}"
    none = "CAST(NULL AS VARCHAR(99)) AS transform_id"
    edges = " UNION ALL ".join([
        f"SELECT DISTINCT concat('t:', l_orderkey) AS src, concat('p:', l_partkey) AS dst, 'READS_FROM' AS rel_type, {none} FROM lineitem",
        f"SELECT DISTINCT concat('s:', l_suppkey), concat('p:', l_partkey), 'READS_FROM', {none} FROM lineitem",
        f"SELECT concat('t:', o_orderkey), concat('c:', o_custkey), 'WRITES_TO', {none} FROM orders",
        derive(3, "p_partkey >= 3"),
        derive(7, "p_partkey >= 7"),
        f"SELECT concat('k:', p_partkey), concat('p:', p_partkey), 'PART_OF', {none} FROM part",
        f"SELECT concat('t:', o_orderkey), concat('l:', o_orderpriority), 'PART_OF', {none} FROM orders",
        f"SELECT concat('c:', c_custkey), concat('n:', c_nationkey), 'PRODUCES', {none} FROM customer",
    ])
    return nodes, edges


TABLES = ["part", "customer", "orders", "lineitem", "supplier", "nation"]


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) as lazy queries over the tables; unused branches and columns are pruned."""
    nodes, edges = (x.replace("VARCHAR(99)", "STRING") for x in _sql("{0} div {1}", "date_format({0}, 'yyyy-MM')"))
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    fill = lambda text: spark.sql(_braced(text), **tables)
    return fill(nodes), fill(edges)


def _braced(text: str) -> str:
    for t in TABLES:
        text = text.replace(f" FROM {t} ", f" FROM {{{t}}} ").replace(f" FROM {t}\n", f" FROM {{{t}}}\n")
        if text.endswith(f" FROM {t}"):
            text = text[: -len(t)] + "{" + t + "}"
    return text


_N, _E = _sql("({0} // {1})", "strftime({0}, '%Y-%m')")
PRELUDE = f"WITH RECURSIVE nodes AS ({_N}), edges AS ({_E})"
