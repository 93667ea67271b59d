"""Events and assets from files, to fill a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.model import EDGE_SCHEMA, EVENT_SCHEMA, node_id
from tracewell.operators.upsert import _wide

ASSET = "label string, name string, project string, owner string, sla_tier string, freshness_cadence string, reads array<struct<project:string,name:string>>, made_from array<struct<project:string,name:string>>"


def events(spark: SparkSession, path: str) -> DataFrame:
    """Lineage events of files that hold a JSON array each; a file is read by one task."""
    return spark.read.schema(EVENT_SCHEMA).json(path, multiLine=True)


def assets(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges, in the stored form, of dashboards and features: a dashboard reads datasets, and
    datasets produce what is made from them. A dashboard's key is its name, a feature's also its project.
    Of assets with one key the least counts; other labels are left out."""
    own = spark.read.schema(ASSET).json(path, multiLine=True).where("label in ('Dashboard', 'MLFeature')")
    key = F.when(F.col("label") == "Dashboard", node_id("Dashboard", F.col("name"))).otherwise(node_id("MLFeature", F.col("project"), F.col("name")))
    own = own.withColumn("id", key)
    one = own.groupBy("id", "label").agg(F.min(F.struct("name", "project", "owner", "sla_tier", "freshness_cadence")).alias("v")).select("id", "label", "v.*")
    parts = [one.where(F.col("label") == n).drop("label") for n in ("Dashboard", "MLFeature")]
    nodes = _wide(parts[0], "Dashboard", "name").unionByName(_wide(parts[1], "MLFeature", "project", "name"))
    set_id = node_id("Dataset", F.col("d.project"), F.col("d.name"))
    reads = own.select("id", F.explode("reads").alias("d")).select(F.col("id").alias("src"), set_id.alias("dst"), F.lit("READS_FROM").alias("rel_type"))
    makes = own.select("id", F.explode("made_from").alias("d")).select(set_id.alias("src"), F.col("id").alias("dst"), F.lit("PRODUCES").alias("rel_type"))
    edges = reads.unionAll(makes).distinct()
    have = dict(x.split() for x in EDGE_SCHEMA.split(", "))
    return nodes, edges.select(*[F.col(c) if c in edges.columns else F.lit(None).cast(t).alias(c) for c, t in have.items()])
