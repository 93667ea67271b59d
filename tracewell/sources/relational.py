"""Tables of a relational database: recorded schema changes and the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.upsert import _wide


def table(spark: SparkSession, url: str, name: str, by: str | None = None, partitions: int = 8, **options: str) -> DataFrame:
    """A table of a database. With a number or time column ``by`` it is read in so many ranges between
    that column's bounds, which the database finds; null stands in the first range. An empty table is one."""
    at = {"url": url, **options}
    if by is None:
        return spark.read.format("jdbc").options(dbtable=name, **at).load()
    low, high = spark.read.format("jdbc").options(query=f"SELECT min({by}) AS low, max({by}) AS high FROM {name}", **at).load().first()
    if low is None:
        return table(spark, url, name, **options)
    return spark.read.format("jdbc").options(dbtable=name, partitionColumn=by, lowerBound=str(low), upperBound=str(high), numPartitions=str(partitions), **at).load()


def pending(changes: DataFrame) -> DataFrame:
    """(dataset, column, ddl, is_alter) of recorded changes that weren't processed, in the stream's form."""
    own = changes.where(~F.coalesce("processed", F.lit(False)))
    return own.select("dataset", F.col("column_name").alias("column"), "ddl", F.coalesce(F.upper("ddl").contains("ALTER"), F.lit(False)).alias("is_alter"))


def catalog_nodes(datasets: DataFrame, columns: DataFrame) -> DataFrame:
    """The catalogue's datasets and columns as nodes in the stored form, for ``merge_nodes`` and for
    looking up missing columns. Without a tier P2, without a cadence daily; repeated keys stand once."""
    sets = datasets.select("project", "name", "source_type", "owner", F.coalesce("sla_tier", F.lit("P2")).alias("sla_tier"), F.coalesce("freshness_cadence", F.lit("daily")).alias("freshness_cadence"), "created_at")
    own = columns.select("project", "dataset", "name", "created_at")
    return _wide(sets, "Dataset", "project", "name").unionByName(_wide(own, "Column", "project", "dataset", "name")).dropDuplicates(["node_id"])
