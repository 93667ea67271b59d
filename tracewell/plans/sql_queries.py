"""Queries over a table of SQL texts, one made of each part, with their DuckDB SQL.

A part's key picks one of the shapes and the names in it: @K stands for the key and @M for the key modulo
seven. A text holds one statement or several; what each has to give is stated row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.runtime import dealt
from tracewell.sources import sql_tables

#: Columns that the catalogue knows, by table.
_KNOWN = {"cat.full@M": ["id", "label", "amount"]}


def _one(kind: str, target: str | None, sources: str, *rows: tuple) -> dict:
    """A statement: its kind, target and tables, and (place, column, dataset, source, expression, passed through)."""
    return {"kind": kind, "target": target, "sources": sources, "rows": list(rows)}


def _skipped() -> dict:
    return _one("other", None, "")


#: (text, what its statements give).
_SHAPES: list[tuple[str, list[dict]]] = [
    ("SELECT a, b@K AS c FROM s.t@M; -- no; statement\nSELECT d FROM u@M", [_one("query", None, "s.t@M", (1, "a", "s.t@M", "a", None, True), (2, "c", "s.t@M", "b@K", None, True)), _one("query", None, "u@M", (1, "d", "u@M", "d", None, True))]),
    ("MERGE INTO m@M USING s ON m.k = s.k WHEN MATCHED THEN DELETE; ALTER TABLE m@M DROP COLUMN c@K; SELECT x FROM ok@K", [_skipped(), _skipped(), _one("query", None, "ok@K", (1, "x", "ok@K", "x", None, True))]),
    ("WITH first AS (SELECT k, v@K * 2 AS w FROM raw.base@M), second AS (SELECT k, w FROM first) SELECT second.w, second.k AS id FROM second JOIN dim@M d ON d.k = second.k", [_one("query", None, "dim@M,raw.base@M", (1, "w", "raw.base@M", "v@K", "second.w", False), (2, "id", "raw.base@M", "k", None, True))]),
    ("WITH RECURSIVE up(id, boss) AS (SELECT e.id, e.boss@M FROM emp@K e UNION ALL SELECT e.id, up.boss FROM emp@K e JOIN up ON e.boss@M = up.id) INSERT INTO mart.tree@K SELECT id, boss FROM up", [_one("insert", "mart.tree@K", "emp@K", (1, "id", "emp@K", "id", None, True), (2, "boss", "emp@K", "boss@M", None, True))]),
    ("CREATE OR REPLACE TABLE mart.n@K USING parquet AS SELECT sum(x.a) AS total, upper(y.b) || '(;' AS name FROM one@M AS x LEFT OUTER JOIN (SELECT b, k FROM two@M WHERE q IN (SELECT q FROM three@M)) y ON x.k = y.k GROUP BY y.b", [_one("create", "mart.n@K", "one@M,three@M,two@M", (1, "total", "one@M", "a", "sum(x.a)", False), (2, "name", "two@M", "b", "upper(y.b) || '(;'", False))]),
    ("INSERT INTO mart.o@K (p, q) SELECT l.a, e FROM big.t@M l LATERAL VIEW explode(l.xs@K) y AS e; SELECT z.m FROM v@M, LATERAL (SELECT max(u.a) AS m FROM u@K u WHERE u.k = v@M.k) z", [_one("insert", "mart.o@K", "big.t@M", (1, "p", "big.t@M", "a", None, True), (2, "q", "big.t@M", "xs@K", "e", False)), _one("query", None, "u@K,v@M", (1, "m", "u@K", "a", "z.m", False))]),
    ("SELECT f.*, g.x AS gx FROM cat.full@M f, other@K g", [_one("query", None, "cat.full@M,other@K", (1, "id", "cat.full@M", "id", None, True), (2, "label", "cat.full@M", "label", None, True), (3, "amount", "cat.full@M", "amount", None, True), (4, "gx", "other@K", "x", None, True))]),
    ("SELECT * FROM (SELECT label, amount * 2 AS twice FROM cat.full@M JOIN plain@K ON amount = k) q", [_one("query", None, "cat.full@M,plain@K", (1, "label", "cat.full@M", "label", None, True), (2, "twice", "cat.full@M", "amount", "amount * 2", False))]),
    ("SELECT w.z@K FROM (SELECT * FROM open@M) w UNION ALL SELECT b FROM more@M", [_one("query", None, "more@M,open@M", (1, "z@K", "open@M", "z@K", "w.z@K", False), (1, "z@K", "more@M", "b", "w.z@K", False))]),
    ("SELECT TOP 5 `a b`, row_number() OVER (PARTITION BY g@K ORDER BY d DESC) rn FROM \"S\".\"T@M\" QUALIFY rn = 1", [_one("query", None, "S.T@M", (1, "a b", "S.T@M", "a b", None, True), (2, "rn", "S.T@M", "g@K", "row_number() OVER (PARTITION BY g@K ORDER BY d DESC)", False), (2, "rn", "S.T@M", "d", "row_number() OVER (PARTITION BY g@K ORDER BY d DESC)", False))]),
    ("SELECT 1 AS one, current_date AS today, count(*) AS n, (SELECT max(r.hi) FROM rates@M r WHERE r.k = t.k) AS top, CASE WHEN t.a > 1 THEN t.b@K::int END AS b FROM main@M t /* ; */", [_one("query", None, "main@M,rates@M", (4, "top", "rates@M", "hi", "(SELECT max(r.hi) FROM rates@M r WHERE r.k = t.k)", False), (5, "b", "main@M", "a", "CASE WHEN t.a > 1 THEN t.b@K::int END", False), (5, "b", "main@M", "b@K", "CASE WHEN t.a > 1 THEN t.b@K::int END", False))]),
    ("SELECT a, t1.b, gone.c FROM t1, t2@K; SELECT 1 AS nothing", [_one("query", None, "t1,t2@K", (1, "a", "unknown", "a", None, True), (2, "b", "t1", "b", None, True), (3, "c", "gone", "c", None, True)), _one("query", None, "")]),
]
_N = len(_SHAPES)
_DB = "replace(replace({}, '@K', p_partkey::VARCHAR), '@M', (p_partkey % 7)::VARCHAR)"


#: A task's texts: a part's key becomes a text of some forty tokens.
_A_TASK = 2000


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey"), "p_partkey", _A_TASK)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(statement_id, sql, dialect): a text of each part."""
    shape = F.get(F.array(*(F.lit(t) for t, _ in _SHAPES)), (F.col("p_partkey") % _N).cast("int"))
    filled = F.replace(F.replace(shape, F.lit("@K"), F.col("p_partkey").cast("string")), F.lit("@M"), (F.col("p_partkey") % 7).cast("string"))
    dialect = F.get(F.array(*map(F.lit, ("redshift", "bigquery", "snowflake", "postgres", "default", "duck"))), (F.col("p_partkey") % 6).cast("int"))
    return _parts(spark, sf_dir).select(F.col("p_partkey").alias("statement_id"), filled.alias("sql"), dialect.alias("dialect"))


def catalogue(spark: SparkSession) -> DataFrame:
    rows = [(t.replace("@M", str(m)), k, c) for t, of in _KNOWN.items() for m in range(7) for k, c in enumerate(of)]
    return spark.createDataFrame(rows, "dataset string, place int, column string")


def _lit(v) -> str:
    return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def _values(columns: str, rows: list[tuple]) -> str:
    return f"part JOIN (VALUES {', '.join('(' + ', '.join(map(_lit, r)) + ')' for r in rows)}) AS t(shape, n, {columns}) ON p_partkey % {_N} = shape"


_STATEMENTS = [(k, n, s["kind"], s["target"], s["sources"]) for k, (_, of) in enumerate(_SHAPES) for n, s in enumerate(of)]
_ROWS = [(k, n, s["target"], *r) for k, (_, of) in enumerate(_SHAPES) for n, s in enumerate(of) for r in s["rows"]]
_ALL = f"""SELECT p_partkey AS id, n, {_DB.format('target')} AS target, place, {_DB.format('col')} AS "column", {_DB.format('dataset')} AS source_dataset, {_DB.format('source')} AS source_column,
    {_DB.format('expr')} AS expression, through AS is_passthrough FROM {_values('target, place, col, dataset, source, expr, through', _ROWS)}"""
_KINDS = f"SELECT p_partkey AS id, n, kind, {_DB.format('target')} AS target FROM {_values('kind, target, sources', _STATEMENTS)}"
_SOURCES = f"SELECT p_partkey AS id, n, unnest(string_split({_DB.format('sources')}, ',')) AS dataset FROM {_values('kind, target, sources', [s for s in _STATEMENTS if s[4]])}"


def _run(spark, sf_dir) -> sql_tables.Extraction:
    return sql_tables.Extraction(texts(spark, sf_dir), catalog=catalogue(spark))


def _derived(spark, sf_dir) -> DataFrame:
    return _run(spark, sf_dir).derivations()


def _of(*shapes: int) -> tuple:
    """The lineage of the texts of some shapes."""
    keys = ", ".join(map(str, shapes))
    return lambda s, d: sql_tables.extract(texts(s, d).where(f"statement_id % {_N} in ({keys})"), catalog=catalogue(s)), f"SELECT * FROM ({_ALL}) WHERE id % {_N} IN ({keys})"


def _found(spark, sf_dir) -> DataFrame:
    return sql_tables.statements(sql_tables.tokens(texts(spark, sf_dir)))


#: (text, its changes: dataset, column, change, new name, new type), one after the other.
_DDL = [
    ("ALTER TABLE s.t@M DROP COLUMN c@K", [("s.t@M", "c@K", "drop_column", None, None)]),
    ("alter table s.t@M rename column a@K to \"b c\"; SELECT 1", [("s.t@M", "a@K", "rename_column", "b c", None)]),
    ("ALTER TABLE cat.s.t@K ADD COLUMN IF NOT EXISTS d@M decimal(10, 2) -- wide\n; DROP TABLE IF EXISTS old.`x@K`", [("s.t@K", "d@M", "add_column", None, "DECIMAL(10,2)"), ("old.x@K", None, "drop_table", None, None)]),
    ("ALTER TABLE t@K ALTER COLUMN v@M TYPE bigint; CREATE TABLE z (a int); ALTER TABLE t@K RENAME TO u@K", [("t@K", "v@M", "type_change", None, "BIGINT"), (None,) * 5, ("t@K", None, "rename_table", "u@K", None)]),
]
_CHANGES = [(k, n, *r) for k, (_, rows) in enumerate(_DDL) for n, r in enumerate(rows) if r[2]]


def statements_of_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(statement_id, sql): statements of each part that change tables."""
    shape = F.get(F.array(*(F.lit(t) for t, _ in _DDL)), (F.col("p_partkey") % len(_DDL)).cast("int"))
    filled = F.replace(F.replace(shape, F.lit("@K"), F.col("p_partkey").cast("string")), F.lit("@M"), (F.col("p_partkey") % 7).cast("string"))
    return _parts(spark, sf_dir).select(F.col("p_partkey").alias("statement_id"), filled.alias("sql"))


TABLE = {
    "l03_schema_changes": (
        lambda s, d: sql_tables.schema_changes(statements_of_change(s, d)),
        f"""SELECT p_partkey AS id, n, {_DB.format('dataset')} AS dataset, {_DB.format('col')} AS "column", change_type, {_DB.format('new_name')} AS new_name, new_type
            FROM {_values('dataset, col, change_type, new_name, new_type', _CHANGES).replace(f'% {_N} =', f'% {len(_DDL)} =')}""",
    ),
    "c01_statements": (lambda s, d: _found(s, d).select("id", "n"), f"SELECT id, n FROM ({_KINDS})"),
    "c02_warehouses": (
        lambda s, d: texts(s, d).select("statement_id", sql_tables.warehouse("dialect").alias("warehouse")),
        "SELECT p_partkey AS statement_id, ['redshift', 'bigquery', 'snowflake', 'postgres', 'generic', 'generic'][p_partkey % 6 + 1] AS warehouse FROM part",
    ),
    "c03_statement_kinds": (lambda s, d: _found(s, d).select("id", "n", "kind"), f"SELECT id, n, kind FROM ({_KINDS})"),
    "c04_common_tables": _of(2, 3),
    "c05_targets": (lambda s, d: _found(s, d).where("kind in ('insert', 'create')").select("id", "n", "target"), f"SELECT id, n, target FROM ({_KINDS}) WHERE kind IN ('insert', 'create')"),
    "c06_tables": (lambda s, d: _run(s, d).sources, _SOURCES),
    "c07_table_counts": (lambda s, d: _run(s, d).sources.groupBy("dataset").agg(F.count(F.lit(1)).alias("n")), f"SELECT dataset, count(*) AS n FROM ({_SOURCES}) GROUP BY dataset"),
    "c08_sql_lineage": (_derived, _ALL),
    "c09_stars": _of(6, 7, 8),
    "c10_lateral_names": _of(5),
    "c10_nested_names": _of(4, 10, 11),
    "c11_output_names": (lambda s, d: _derived(s, d).select("id", "n", "place", "column").distinct(), f'SELECT DISTINCT id, n, place, "column" FROM ({_ALL})'),
    "c12_passed_through": (lambda s, d: _derived(s, d).where("is_passthrough").select("id", "n", "column", "source_column"), f'SELECT id, n, "column", source_column FROM ({_ALL}) WHERE is_passthrough'),
    "c13_texts": (lambda s, d: _derived(s, d).where("expression is not null").select("id", "n", "place", "expression").distinct(), f"SELECT DISTINCT id, n, place, expression FROM ({_ALL}) WHERE expression IS NOT NULL"),
    "c14_columns_without_source": (
        lambda s, d: _run(s, d).without_source().groupBy("id").agg(F.count(F.lit(1)).alias("n")),
        f"SELECT p_partkey AS id, CASE p_partkey % {_N} WHEN 10 THEN 3 ELSE 1 END::BIGINT AS n FROM part WHERE p_partkey % {_N} IN (10, 11)",
    ),
    "c15_given_sources": (
        lambda s, d: sql_tables.events(_run(s, d), F.expr("array(concat('given', id % 3))")).select("id", "n", F.array_join("source_datasets", ",").alias("source_datasets")),
        f"SELECT id, n, string_agg(dataset, ',' ORDER BY dataset) AS source_datasets FROM (SELECT id, n, dataset FROM ({_SOURCES}) UNION SELECT id, n, concat('given', id % 3) FROM ({_KINDS}) WHERE kind <> 'other') GROUP BY id, n",
    ),
    "c16_events": (
        lambda s, d: sql_tables.events(_run(s, d)).select("id", "n", "target", F.array_join("source_datasets", ",").alias("source_datasets")),
        f"SELECT p_partkey AS id, n, {_DB.format('target')} AS target, {_DB.format('sources')} AS source_datasets FROM {_values('kind, target, sources', [s for s in _STATEMENTS if s[4]])}",
    ),
    "c17_transform_ids": (
        lambda s, d: texts(s, d).select("statement_id", sql_tables.transform_id("sql").alias("transform_id")),
        f"SELECT p_partkey AS statement_id, sha256({_DB.format('sql')})[1:16] AS transform_id FROM part JOIN (VALUES {', '.join(f'({k}, {_lit(t)})' for k, (t, _) in enumerate(_SHAPES))}) AS t(shape, sql) ON p_partkey % {_N} = shape",
    ),
}
