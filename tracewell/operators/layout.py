"""Presentation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the layout: order of columns and spacing.
TYPE_ORDER = ["Dataset", "Transform", "Column", "Pipeline", "Dashboard", "MLFeature"]
X, Y = 260, 80


def grid(nodes: DataFrame) -> DataFrame:
    """(node_id, label, x, y): labels side by side in a fixed order without gaps, nodes below each other by id.

    The ranks of a label are windows over one screen of nodes (``graph_nodes`` limits them)."""
    place = F.array_position(F.array(*map(F.lit, TYPE_ORDER)), F.col("label"))
    own = nodes.where(F.col("label").isin(*TYPE_ORDER)).withColumn("place", place)
    cols = own.select("place").distinct().withColumn("col", F.row_number().over(Window.orderBy("place")) - 1)
    row = F.row_number().over(Window.partitionBy("label").orderBy("node_id")) - 1
    return own.join(F.broadcast(cols), "place").select("node_id", "label", (F.col("col") * X).cast("long").alias("x"), (row * Y).cast("long").alias("y"))


def chain_text(chains: DataFrame, column: str = "chain") -> DataFrame:
    """The chain as text."""
    return chains.withColumn("text", F.array_join(column, " → "))
