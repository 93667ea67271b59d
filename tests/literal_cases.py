"""SQL texts and plans for the extraction on the driver, each with its rows as SQL."""

from __future__ import annotations

import json

from tracewell.sources import plan_json
from tracewell.sources.sql_lineage import extract, schema_changes


def _table(columns: str, rows: list[tuple]) -> str:
    said = ", ".join("(" + ", ".join("NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + str(v).replace("'", "''") + "'" for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {said}) v({columns})"


def _derived(events_: list[dict]) -> list[tuple]:
    return [(e["target_datasets"][0], d["target"]["column"], d["source"]["dataset"], d["source"]["column"], d["is_passthrough"]) for e in events_ for d in e["column_derivations"]]


_LINEAGE = "target string, name string, dataset string, source string, is_passthrough boolean"


def _case(sql: str, rows: list[tuple], **options):
    def run(spark, _):
        return spark.createDataFrame(_derived(extract(spark, sql, "p", **options)), _LINEAGE)

    return run, _table("target, name, dataset, source, is_passthrough", rows)


def _found(sql: str, rows: list[tuple], **options):
    """The source datasets of a text's events."""

    def run(spark, _):
        return spark.createDataFrame([(s,) for e in extract(spark, sql, "p", "o", **options) for s in e["source_datasets"]], "source string")

    return run, _table("source", rows)


def _nothing(sql: str):
    return lambda spark, _: spark.createDataFrame([(len(extract(spark, sql, "p", "o")),)], "events int"), "SELECT 0 AS events"


_C = {
    "c01_statements": _case("SELECT a FROM s.t; SELECT b AS c FROM u -- ; not here\n;", [("o", "a", "s.t", "a", True), ("o", "c", "u", "b", True)], target_dataset="o"),
    "c01_unreadable": _nothing("SELEC a FROM t"),
    "c02_warehouse": (lambda s, _: s.createDataFrame([(n, extract(s, "SELECT a FROM t", "p", "o", dialect=n)[0]["column_derivations"][0]["source"]["warehouse"]) for n in ("snowflake", "redshift", "mysql")], "dialect string, warehouse string"), _table("dialect, warehouse", [("snowflake", "snowflake"), ("redshift", "redshift"), ("mysql", "generic")])),
    "c03_skipped_statements": _nothing("MERGE INTO t USING s ON t.k = s.k WHEN MATCHED THEN UPDATE SET t.v = s.v; ALTER TABLE t DROP COLUMN c; DELETE FROM t WHERE k = 1; DROP TABLE t"),
    "c04_common_tables": _case("WITH a AS (SELECT k, v * 2 AS w FROM s.base), b AS (SELECT k, w FROM a) SELECT b.w, b.k FROM b", [("o", "w", "s.base", "v", False), ("o", "k", "s.base", "k", True)], target_dataset="o"),
    "c05_insert_under_with": _case("WITH a AS (SELECT x FROM s.t) INSERT INTO w.o SELECT x FROM a", [("w.o", "x", "s.t", "x", True)]),
    "c05_create": _case("CREATE TABLE w.n AS SELECT x + y AS z FROM t", [("w.n", "z", "t", "x", False), ("w.n", "z", "t", "y", False)]),
    "c06_tables_of_conditions": _found("SELECT a FROM t WHERE a IN (SELECT b FROM u) AND EXISTS (SELECT 1 FROM s.v WHERE v.k = t.k) AND c > (SELECT max(d) FROM w)", [("t",), ("u",), ("s.v",), ("w",)]),
    "c06_tables_of_having_and_on": _found("SELECT a, count(*) AS n FROM t JOIN x ON t.k = x.k AND x.k IN (SELECT k FROM y) GROUP BY a HAVING count(*) > (SELECT min(m) FROM z)", [("t",), ("x",), ("y",), ("z",)]),
    "c07_names": _case('SELECT q."A", "B" FROM "S"."T" q', [("o", "A", "S.T", "A", True), ("o", "B", "S.T", "B", True)], target_dataset="o"),
    "c08_joined_projection": _case("SELECT l.a, r.b * l.c AS d FROM s.l l LEFT JOIN s.r r ON l.k = r.k", [("o", "a", "s.l", "a", True), ("o", "d", "s.r", "b", False), ("o", "d", "s.l", "c", False)], target_dataset="o"),
    "c09_stars": _case("SELECT u.* FROM t JOIN u ON t.k = u.k", [("o", "*", "u", "*", True)], target_dataset="o"),
    "c09_known_stars": _case("SELECT * FROM t", [("o", "x", "t", "x", True), ("o", "y", "t", "y", True)], target_dataset="o", catalog={"t": ["x", "y"]}),
    "c10_windows_and_subqueries": _case("SELECT sum(v) OVER (PARTITION BY g ORDER BY d) AS s, (SELECT max(m) FROM u) AS top FROM t", [("o", "s", "t", "v", False), ("o", "s", "t", "g", False), ("o", "s", "t", "d", False), ("o", "top", "u", "m", False)], target_dataset="o"),
    "c10_unqualified_as_implemented": _case("SELECT a AS b FROM t", [("o", "b", "unknown", "a", True)], target_dataset="o", semantics="as_implemented"),
    "c11_output_names": _case("SELECT a AS first, b, upper(c) AS `the c` FROM t", [("o", "first", "t", "a", True), ("o", "b", "t", "b", True), ("o", "the c", "t", "c", False)], target_dataset="o"),
    "c12_passthrough": _case("SELECT a AS b, cast(a AS INT) AS i, coalesce(a, c) AS m FROM t", [("o", "b", "t", "a", True), ("o", "i", "t", "a", False), ("o", "m", "t", "a", False), ("o", "m", "t", "c", False)], target_dataset="o"),
    "c13_expressions": (lambda s, _: s.createDataFrame([(d["target"]["column"], d["expression"]) for d in extract(s, "SELECT a, b * 2 AS t FROM t", "p", "o")[0]["column_derivations"]], "name string, expression string"), _table("name, expression", [("a", None), ("t", "(b * 2) AS t")])),
    "c14_literals": _case("SELECT 1 AS one, current_date() AS today, count(*) AS n, a FROM t GROUP BY a", [("o", "a", "t", "a", True)], target_dataset="o"),
    "c15_given_sources": _found("SELECT a FROM t", [("t",), ("z",)], source_datasets=["z", "t"]),
    "c16_no_sources": _nothing("SELECT 1 AS one"),
    "c17_ids": (lambda s, _: s.createDataFrame([(extract(s, q, "p", "o", transform_id=t)[0]["transform_id"],) for q, t in (("SELECT a FROM t", None), ("SELECT a FROM t", "mine"))], "transform_id string"), "SELECT substr(sha256('SELECT a FROM t'), 1, 16) AS transform_id UNION ALL SELECT 'mine'"),
    "c_union": _case("SELECT a, b FROM t UNION ALL SELECT c, b FROM u", [("o", "a", "t", "a", False), ("o", "a", "u", "c", False), ("o", "b", "t", "b", False), ("o", "b", "u", "b", False)], target_dataset="o"),
    "l03_schema_changes": (
        lambda s, _: s.createDataFrame([(x["dataset"], x["column"], x["change_type"], x["new_name"], x["new_type"]) for x in schema_changes(s, "ALTER TABLE s.t DROP COLUMN a; ALTER TABLE s.t RENAME COLUMN b TO c; ALTER TABLE t ADD COLUMN d INT; ALTER TABLE t ALTER COLUMN d TYPE BIGINT; DROP TABLE s.old; ALTER TABLE s.t RENAME TO s.u; UPDATE t SET a = 1")], "dataset string, column string, change_type string, new_name string, new_type string"),
        _table('dataset, "column", change_type, new_name, new_type', [("s.t", "a", "drop_column", None, None), ("s.t", "b", "rename_column", "c", None), ("t", "d", "add_column", None, "INT"), ("t", "d", "type_change", None, "BIGINT"), ("s.old", None, "drop_table", None, None), ("s.t", None, "rename_table", "s.u", None)]),
    ),
}


def _attr(name: str, id_: int | None = None, table: str = "invoices") -> dict:
    return {"class": "AttributeReference", "name": name, "qualifier": ["bill", table]} | ({"exprId": {"id": id_, "jvmId": "j"}} if id_ else {})


def _alias(name: str, e: dict, id_: int | None = None) -> dict:
    return {"class": "Alias", "name": name, "child": e} | ({"exprId": {"id": id_, "jvmId": "j"}} if id_ else {})


def _rel(table: str, *attrs: dict) -> dict:
    return {"class": "LogicalRelation", "catalogTable": {"identifier": {"database": "bill", "table": table}}, "output": list(attrs)}


def _write(child: dict, **target) -> dict:
    return {"class": "AppendData", "children": [child], **target}


_INVOICES, _CLIENTS = _rel("invoices", _attr("num", 1), _attr("net", 2), _attr("tax", 3), _attr("cl", 4)), _rel("clients", _attr("cl", 5, "clients"), _attr("land", 6, "clients"))
_GROSS = {"class": "Add", "children": [_attr("net", 2), _attr("tax", 3)]}
_JOINED = {"class": "Project", "projectList": [_attr("num", 1), _alias("gross", _GROSS, 9), _alias("country", _attr("land", 6, "clients"), 10)], "children": [{"class": "Join", "children": [_INVOICES, _CLIENTS]}]}
_SUMS = {"class": "Aggregate", "aggregateExpressions": [_alias("country", _attr("country", 10), 11), _alias("total", {"class": "Sum", "children": [_attr("gross", 9)]}, 12)], "children": [_JOINED]}
_OVER = {"class": "Window", "windowExpressions": [_alias("rank", {"class": "RowNumber", "children": [_attr("net", 2)]}, 20)], "children": [_INVOICES]}


def _plan(plan, rows: list[tuple], **options):
    def run(spark, _):
        return spark.createDataFrame(_derived(plan_json.extract(plan, "p", **options)), _LINEAGE)

    return run, _table("target, name, dataset, source, is_passthrough", rows)


def _targets(*plans: dict):
    return lambda spark, _: spark.createDataFrame([(e["transform_name"],) for p in plans for e in plan_json.extract(p, "p")], "target string")


_E = {
    "e01_joined_relations": _plan(_write(_JOINED, outputPath="hdfs://lake/open/"), [("open", "num", "bill.invoices", "num", True), ("open", "gross", "bill.invoices", "net", False), ("open", "gross", "bill.invoices", "tax", False), ("open", "country", "bill.clients", "land", False)]),
    "e04_aggregates": _plan(_write(_SUMS, outputPath="/lake/sums"), [("sums", "country", "bill.clients", "land", True), ("sums", "total", "bill.invoices", "net", False), ("sums", "total", "bill.invoices", "tax", False)]),
    "e05_windows": _plan(_write(_OVER, outputPath="w"), [("w", "rank", "bill.invoices", "net", False)]),
    "e06_as_implemented": _plan(_write(_JOINED, outputPath="o"), [("o", "num", "bill.invoices", "num", True), ("o", "gross", "bill.invoices", "net", False), ("o", "country", "bill.invoices", "land", False)], semantics="as_implemented"),
    "e10_expressions": (lambda s, _: s.createDataFrame([(d["target"]["column"], d["expression"]) for d in plan_json.extract(_write(_JOINED, outputPath="o"), "p")[0]["column_derivations"]], "name string, expression string"), _table("name, expression", [("num", None), ("gross", "Add(net, tax)"), ("gross", "Add(net, tax)"), ("country", None)])),
    "e11_targets": (_targets(_write(_INVOICES, outputPath="s3://a/b/c/"), _write(_INVOICES, options={"dbtable": "x.y"}), _write(_INVOICES, options={"path": "/p/q"}), _write(_INVOICES, tableIdent={"multipartIdentifier": ["cat", "db", "t"]}), _write(_INVOICES)), _table("target", [("c",), ("x.y",), ("q",), ("db.t",), ("unknown",)])),
    "e12_sources": (lambda s, _: s.createDataFrame([(x,) for x in plan_json.extract(_write(_SUMS, outputPath="o"), "p")[0]["source_datasets"]], "source string"), _table("source", [("bill.invoices",), ("bill.clients",)])),
    "e13_nested_writes": (_targets({"class": "Union", "children": [_write(_INVOICES, outputPath="one"), {"class": "Project", "children": [_write(_CLIENTS, outputPath="two")]}]}), _table("target", [("one",), ("two",)])),
    "e02_no_write": (lambda s, _: s.createDataFrame([(len(plan_json.extract(json.dumps(_JOINED), "p")),)], "events int"), "SELECT 0 AS events"),
}

TABLE = _C | _E
