"""Queries over a table of logical plans, one made of each order, with their DuckDB SQL.

An order's key picks one of six shapes and, with its customer, the names in it. What each shape has to
give is stated row by row; both are templates in which @K stands for the key and @C for the customer.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.runtime import dealt
from tracewell.sources import plan_tables


def _attr(name: str, id_: int | None, *qualifier: str) -> list[dict]:
    return [{"class": "org.apache.spark.sql.catalyst.expressions.AttributeReference", "num-children": 0, "name": name, "exprId": {"id": f"@K{id_:02d}", "jvmId": "j"}, "qualifier": list(qualifier)}]


def _expr(kind: str, *kids: list[dict], **fields) -> list[dict]:
    return [{"class": f"org.apache.spark.sql.catalyst.expressions.{kind}", "num-children": len(kids), **fields}, *(n for k in kids for n in k)]


def _alias(name: str, id_: int, e: list[dict]) -> list[dict]:
    return _expr("Alias", e, name=name, exprId={"id": f"@K{id_:02d}", "jvmId": "j"})


def _node(kind: str, *kids: list[dict], **fields) -> list[dict]:
    return [{"class": f"org.apache.spark.sql.catalyst.plans.logical.{kind}", "num-children": len(kids), **fields}, *(n for k in kids for n in k)]


def _table(name: str, *columns: list[dict], kind: str = "LogicalRelation", at: str = "catalogTable") -> list[dict]:
    return _node(kind, output=list(columns), **({at: {"identifier": {"database": name.split(".")[0], "table": name.split(".")[1]}}} if at else {}))


_BILLS = _table("bill.i@C", _attr("num", 1), _attr("net", 2), _attr("tax", 3), _attr("cust", 4))
_CLIENTS = _table("crm.c@C", _attr("id", 5), _attr("land", 6), kind="HiveTableRelation", at="tableMeta")
_JOIN = _node("Join", _node("SubqueryAlias", _BILLS), _node("Filter", _CLIENTS), joinType="Inner")
_GROSS = _node("Project", _JOIN, projectList=[_attr("num", 1), _alias("gross", 7, _expr("Add", _attr("net", 2), _attr("tax", 3))), _alias("country", 8, _attr("land", 6))])
_NESTED = {
    "class": "org.apache.spark.sql.execution.datasources.SaveIntoDataSourceCommand", "options": {"path": "s3://lake/ranks@K/"},
    "children": [{"type": "Window", "windowExpressions": [{"class": "Alias", "name": "rank", "children": [{"class": "RowNumber", "children": [{"class": "AttributeReference", "name": "net@K"}]}]}],
                  "child": {"class": "StreamingRelation", "output": [{"class": "AttributeReference", "name": "net@K", "qualifier": ["spark_catalog", "live", "s@C"]}]}}],
}

_SHAPES: list = [
    _node("InsertIntoHadoopFsRelationCommand", _GROSS, outputPath="hdfs://lake/open@C/"),
    _node("AppendData", _node("Aggregate", _GROSS, aggregateExpressions=[_attr("country", 8), _alias("total", 9, _expr("Sum", _attr("gross", 7))), _alias("n", 10, _expr("Count", _expr("Literal", value="1")))]), options={"dbtable": "mart.sums@K"}),
    _NESTED,
    _node(
        "OverwriteByExpression",
        _node("Union", _node("Project", _BILLS, projectList=[_attr("num", 1), _alias("v", 11, _expr("Multiply", _attr("net", 2), _expr("Literal", value="2")))]), _node("Project", _CLIENTS, projectList=[_attr("id", 5), _attr("land", 6)]), _node("Union", _node("Project", _JOIN, projectList=[_attr("cust", 4), _attr("land", 6)]), _node("Project", _BILLS, projectList=[_attr("tax", 3), _attr("net", 2)]))),
        tableIdent={"multipartIdentifier": ["cat", "mart", "both@C"]},
    ),
    _node("Project", _JOIN, projectList=[_attr("num", 1)]),
    _node(
        "InsertIntoDataSourceCommand",
        _node("Project", _node("Join", _node("Project", _BILLS, projectList=[_alias("bill", 12, _attr("num", 1)), _attr("cust", 4)]), _node("AppendData", _node("Project", _CLIENTS, projectList=[_attr("id", 5)]), path="inner"), joinType="LeftSemi"), projectList=[_attr("bill", 12), _alias("twice", 13, _expr("Concat", _attr("bill", 12), _attr("bill", 12)))]),
    ),
]

#: For each shape: (column, source dataset, source column, expression, passed through).
_ROWS = [
    [("num", "bill.i@C", "num", None, True), ("gross", "bill.i@C", "net", "Add(net, tax)", False), ("gross", "bill.i@C", "tax", "Add(net, tax)", False), ("country", "crm.c@C", "land", None, False)],
    [("country", "crm.c@C", "land", None, True), ("total", "bill.i@C", "net", "Sum(gross)", False), ("total", "bill.i@C", "tax", "Sum(gross)", False)],
    [("rank", "live.s@C", "net@K", "RowNumber(net@K)", False)],
    [("num", "bill.i@C", "num", None, True), ("num", "crm.c@C", "id", None, True), ("num", "bill.i@C", "cust", None, True), ("num", "bill.i@C", "tax", None, True), ("v", "bill.i@C", "net", "Multiply(net, 2)", False), ("v", "crm.c@C", "land", "Multiply(net, 2)", False)],
    [],
    [("bill", "bill.i@C", "num", None, True), ("twice", "bill.i@C", "num", "Concat(bill, bill)", False)],
]
_PLAIN = [
    [("num", "bill.i@C", "num", None, True), ("gross", "bill.i@C", "net", "Add(net, tax)", False), ("country", "bill.i@C", "land", None, False)],
    [("num", "bill.i@C", "num", None, True), ("gross", "bill.i@C", "net", "Add(net, tax)", False), ("country", "bill.i@C", "land", None, False), ("country", "bill.i@C", "country", None, True), ("total", "bill.i@C", "gross", "Sum(gross)", False)],
    [],
    [("num", "bill.i@C", "num", None, True), ("v", "bill.i@C", "net", "Multiply(net, 2)", False), ("id", "bill.i@C", "id", None, True), ("land", "bill.i@C", "land", None, True), ("cust", "bill.i@C", "cust", None, True), ("land", "bill.i@C", "land", None, True), ("tax", "bill.i@C", "tax", None, True), ("net", "bill.i@C", "net", None, True)],
    [],
    [("bill", "bill.i@C", "num", None, False), ("cust", "bill.i@C", "cust", None, True), ("id", "bill.i@C", "id", None, True), ("bill", "bill.i@C", "bill", None, True), ("twice", "bill.i@C", "bill", "Concat(bill, bill)", False)],
]
_TARGETS = ["open@C", "mart.sums@K", "ranks@K", "mart.both@C", None, "unknown"]
_SOURCES = ["bill.i@C,crm.c@C", "bill.i@C,crm.c@C", "live.s@C", "bill.i@C,crm.c@C", None, "bill.i@C,crm.c@C"]
#: (shape, class, relation, how often it stands in the plan).
_RELATIONS = [(k, "LogicalRelation", "bill.i@C", n) for k, n in enumerate([1, 1, 0, 3, 1, 1]) if n] + [(k, "HiveTableRelation", "crm.c@C", n) for k, n in enumerate([1, 1, 0, 2, 1, 1]) if n] + [(2, "StreamingRelation", "live.s@C", 1)]
_DB = "replace(replace({}, '@K', o_orderkey::VARCHAR), '@C', o_custkey::VARCHAR)"


#: A task's plans: an order's few bytes become a plan of some kilobytes and twenty nodes.
_A_TASK = 5000


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(plan_id, plan, job_id): a plan of each order."""
    orders = dealt(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey"), "o_orderkey", _A_TASK)
    # A shape's text is pieced together: replacing within some kilobytes costs more than reading them.
    key, customer = (F.col(c).cast("string") for c in ("o_orderkey", "o_custkey"))
    texts = [F.concat(*({"@K": key, "@C": customer}.get(x, F.lit(x)) for x in re.split("(@K|@C)", json.dumps(s)))) for s in _SHAPES]
    shape, filled = F.col("o_orderkey") % len(_SHAPES), F.lit(None)
    for k, text in enumerate(texts):
        filled = F.when(shape == k, text).otherwise(filled)
    return orders.select(F.col("o_orderkey").alias("plan_id"), filled.alias("plan"), F.concat(F.lit("job"), F.col("o_orderkey") % 10).alias("job_id"))


def _lit(v) -> str:
    return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def _values(columns: str, rows: list[tuple]) -> str:
    """The rows of the shapes, (shape, ...), for each order of that shape."""
    return f"orders JOIN (VALUES {', '.join('(' + ', '.join(map(_lit, r)) + ')' for r in rows)}) AS t(shape, {columns}) ON o_orderkey % {len(_SHAPES)} = shape"


def _derived(rows: list[list[tuple]]) -> str:
    flat = [(k, target, *r) for k, (target, of) in enumerate(zip(_TARGETS, rows, strict=True)) for r in of]
    names = [("target", "target"), ("col", '"column"'), ("dataset", "source_dataset"), ("source", "source_column"), ("text", "expression")]
    return f"SELECT o_orderkey AS plan_id, {', '.join(f'{_DB.format(a)} AS {b}' for a, b in names)}, through AS is_passthrough FROM {_values('target, col, dataset, source, text, through', flat)}"


def _kinds() -> dict[tuple[int, str], int]:
    out: dict[tuple[int, str], int] = {}
    for k, s in enumerate(_SHAPES):
        for n in plan_tables.tree(s) if isinstance(s, dict) else s:
            kind = n["class"].rsplit(".", 1)[-1]
            out[k, kind] = out.get((k, kind), 0) + 1
    return out


def _all(spark, sf_dir, **options):
    return plan_tables.derivations(plans(spark, sf_dir), **options).drop("write", "position")


_WRITTEN = [(k, t, s) for k, (t, s) in enumerate(zip(_TARGETS, _SOURCES, strict=True)) if t]
_EVENT = f"SELECT o_orderkey AS plan_id, concat('job', o_orderkey % 10, '_', {_DB.format('target')}) AS transform_id, {_DB.format('target')} AS target_dataset, {_DB.format('sources')} AS source_datasets FROM {_values('target, sources', _WRITTEN)}"


def _events(spark, sf_dir):
    return plan_tables.events(plans(spark, sf_dir)).withColumn("source_datasets", F.array_join("source_datasets", ","))


TABLE = {
    "e01_classes": (
        lambda s, d: plan_tables.nodes(plans(s, d), columns=False).groupBy("kind").agg(F.count(F.lit(1)).alias("n")),
        f"SELECT kind, sum(times)::BIGINT AS n FROM {_values('kind, times', [(k, c, n) for (k, c), n in _kinds().items()])} GROUP BY kind",
    ),
    "e02_topmost_writes": (lambda s, d: _events(s, d).groupBy("plan_id").agg(F.count(F.lit(1)).alias("writes")), f"SELECT plan_id, count(*) AS writes FROM ({_EVENT}) GROUP BY plan_id"),
    "e04_relations": (
        lambda s, d: plan_tables.nodes(plans(s, d), columns=False).where("relation is not null").groupBy("kind", "relation").agg(F.count(F.lit(1)).alias("n")),
        f"SELECT kind, {_DB.format('name')} AS relation, sum(times)::BIGINT AS n FROM {_values('kind, name, times', _RELATIONS)} GROUP BY ALL",
    ),
    "e05_windows": (lambda s, d: _all(s, d).where("expression like 'RowNumber%'"), f"SELECT * FROM ({_derived(_ROWS)}) WHERE expression LIKE 'RowNumber%'"),
    "e06_plan_lineage": (lambda s, d: _all(s, d), _derived(_ROWS)),
    "e06_plan_lineage_as_implemented": (lambda s, d: _all(s, d, semantics="as_implemented"), _derived(_PLAIN)),
    "e07_stored_columns": (lambda s, d: _all(s, d).select("plan_id", "target", "column").distinct(), f'SELECT DISTINCT plan_id, target, "column" FROM ({_derived(_ROWS)})'),
    "e08_passed_through": (lambda s, d: _all(s, d).where("is_passthrough").select("plan_id", "column", "source_column"), f'SELECT plan_id, "column", source_column FROM ({_derived(_ROWS)}) WHERE is_passthrough'),
    "e09_first_names": (lambda s, d: _all(s, d, semantics="as_implemented").groupBy("source_column").agg(F.count(F.lit(1)).alias("n")), f"SELECT source_column, count(*) AS n FROM ({_derived(_PLAIN)}) GROUP BY ALL"),
    "e10_expressions": (lambda s, d: _all(s, d).where("expression is not null").select("plan_id", "column", "expression").distinct(), f'SELECT DISTINCT plan_id, "column", expression FROM ({_derived(_ROWS)}) WHERE expression IS NOT NULL'),
    "e11_targets": (lambda s, d: _events(s, d).select("plan_id", "target_dataset"), f"SELECT plan_id, target_dataset FROM ({_EVENT})"),
    "e12_sources": (lambda s, d: _events(s, d).select("plan_id", F.explode(F.split("source_datasets", ",")).alias("source")), f"SELECT plan_id, unnest(string_split(source_datasets, ',')) AS source FROM ({_EVENT})"),
    "e13_plan_events": (_events, _EVENT),
}
