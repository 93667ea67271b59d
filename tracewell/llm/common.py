"""What the corpus operators share: bounded batches and components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.runtime import forget, hand_over, materialize, scratch_path, shared_dir, ship

__all__ = ["arrow_rows", "connected_components", "forget", "free_name", "hand_over", "materialize", "scratch_path", "shared_dir"]


#: Bytes of an Arrow batch, whatever the rows.
BATCH_BYTES = 16 << 20


def arrow_rows(spark: SparkSession, rows: int) -> None:
    """Bounds the rows and the bytes of an Arrow batch, for long texts share a batch's memory; ships the package to the workers."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores behind it as make it none of the frame's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of the edges (src, dst); component is the least node.

    Each round takes the least label of the neighbours and then the label of the label, so the
    rounds grow with the logarithm of the longest chain. The labels stay in tables; the driver
    sees one count a round. No edges: no rows. Repeated edges and loops change nothing.
    """
    both = materialize(edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), name)
    table = materialize(both.groupBy(F.col("src").alias("node")).agg(F.least(F.col("node"), F.min("dst")).alias("component")), name)
    while True:
        labels = table.select("node", "component")
        near = both.join(labels.select(F.col("node").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("near"))
        step = materialize(labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component")), name)
        up = step.select(F.col("node").alias("component"), F.col("component").alias("up"))
        jumped = materialize(step.join(up, "component").select("node", "old", F.least("component", "up").alias("component")), name)
        forget(table, step)
        table = jumped
        if jumped.where("old <> component").isEmpty():
            forget(both)
            return hand_over(table, table.select("node", "component"))
