"""dbt manifests to lineage events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.runtime import materialize
from tracewell.sources.sql_lineage import extract
from tracewell.sources.sql_tables import extract as extract_table

#: Kinds of nodes that have lineage.
KINDS = ["model", "snapshot", "seed", "analysis"]
_NODE = "struct<name:string,alias:string,schema:string,resource_type:string,package_name:string,fqn:array<string>,config:struct<materialized:string,enabled:boolean>,depends_on:struct<nodes:array<string>>,compiled_sql:string,compiled_code:string,columns:map<string,struct<name:string>>,tags:array<string>>"
MANIFEST = f"nodes map<string,{_NODE}>, sources map<string,struct<name:string,source_name:string,resource_type:string>>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row of typed maps for each manifest file."""
    return spark.read.text(path, wholetext=True).select(F.from_json("value", MANIFEST).alias("m")).select("m.nodes", "m.sources")


def _name(of: str):
    base = F.coalesce(F.nullif(F.col(f"{of}.alias"), F.lit("")), F.col(f"{of}.name"), F.lit(""))
    schema = F.nullif(F.col(f"{of}.schema"), F.lit(""))
    return F.when(schema.isNull(), base).otherwise(F.concat(schema, F.lit("."), base))


def models(manifest: DataFrame) -> DataFrame:
    """(key, target, deps, sql, columns, pipeline, tags): nodes that are enabled and depend on something
    or have compiled SQL; deps in the manifest's order, unknown ones dropped (D01-D05, D08, D09)."""
    nodes = manifest.select(F.explode("nodes").alias("key", "n"))
    known = nodes.select(F.col("key").alias("dep"), _name("n").alias("dep_name"))
    sources = manifest.select(F.explode("sources").alias("dep", "s")).select("dep", F.concat_ws(".", "s.source_name", "s.name").alias("dep_name"))
    own = nodes.where(F.col("n.resource_type").isin(*KINDS) & ~F.col("n.config.enabled").eqNullSafe(False))
    deps = own.select("key", F.posexplode("n.depends_on.nodes").alias("pos", "dep")).join(known.unionAll(sources), "dep").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "dep_name"))).alias("d"))
    out = own.join(deps, "key", "left").select("key", "n", F.coalesce(F.transform("d", lambda x: x["dep_name"]), F.array().cast("array<string>")).alias("deps"))
    out = out.where((F.size("deps") > 0) | (F.coalesce("n.compiled_sql", F.lit("")) != ""))
    tags = F.to_json(F.struct("n.resource_type", "n.config.materialized", "n.tags", F.col("n.package_name").alias("package")))
    return out.select("key", _name("n").alias("target"), "deps", F.coalesce(F.nullif(F.col("n.compiled_sql"), F.lit("")), F.col("n.compiled_code")).alias("sql"), F.transform(F.map_values("n.columns"), lambda c: c["name"]).alias("columns"), F.get("n.fqn", F.lit(0)).alias("pipeline"), tags.alias("tags"))


def lineage(own: DataFrame) -> DataFrame:
    """(key, target, column, source_dataset, source_column, is_passthrough) for all models at once, in joins.

    A model with dependencies has the lineage of its SQL; one whose SQL gives none has its declared columns
    from the first dependency. Models without dependencies, and those without SQL and columns, give no rows.
    """
    own = materialize(own.where(F.size("deps") > 0).select("key", "target", "deps", "sql", "columns"), "dbt-models")
    found = extract_table(own.where(F.coalesce("sql", F.lit("")) != ""), "key", "sql")
    read = found.select(F.col("id").alias("key"), "column", "source_dataset", "source_column", "is_passthrough").join(own.select("key", "target"), "key")
    declared = own.join(found.select(F.col("id").alias("key")).distinct(), "key", "left_anti").select("key", "target", F.explode("columns").alias("column"), F.get("deps", F.lit(0)).alias("source_dataset"))
    declared = declared.withColumn("source_column", F.col("column")).withColumn("is_passthrough", F.lit(True))
    names = ["key", "target", "column", "source_dataset", "source_column", "is_passthrough"]
    return read.select(*names).unionAll(declared.select(*names))


def ingest(spark: SparkSession, path: str, project: str, commit: str | None = None, semantics: str = "documented") -> list[dict]:
    """The events of a manifest. The SQL is parsed on the driver, model by model (D06); without any
    derivation, declared columns come from the first dependency (D07)."""
    out = []
    for m in models(read_manifest(spark, path)).orderBy("key").toLocalIterator():
        derived = []
        if m["sql"] and m["deps"]:
            try:
                derived = [d for e in extract(spark, m["sql"], project, m["target"], list(m["deps"]), semantics=semantics) for d in e["column_derivations"]]
            except Exception:  # noqa: BLE001 - a model's SQL may be of another dialect
                derived = []
        if not derived and m["deps"]:
            ref = lambda d, c: {"dataset": d, "column": c, "warehouse": "generic"}
            derived = [{"source": ref(m["deps"][0], c), "target": ref(m["target"], c), "expression": None, "is_passthrough": True} for c in m["columns"] or []]
        out.append({"event_id": f"{m['key']}@{commit}", "source_type": "dbt", "project_name": project, "commit_id": commit, "transform_id": m["key"], "transform_name": m["target"].split(".")[-1], "pipeline_name": m["pipeline"], "source_datasets": list(m["deps"]), "target_datasets": [m["target"]], "column_derivations": derived, "raw_sql": m["sql"], "tags": m["tags"], "llm_inferred": False, "validation_status": "ok"})
    return out
