"""Scoring, ranking and reports of what a schema change breaks (I01-I11, 2.O)."""

from __future__ import annotations

import hashlib
import json
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.model import LABELS, RELATIONSHIPS, SLA_TIERS
from tracewell.operators.traverse import DEPTH, bfs, fan_out, longest_trail, paths_from
from tracewell.runtime import materialize, stored

#: Fixed values of the score: weights of tiers and cadences, parts of the sum, full fan-out, rows kept.
SLA_WEIGHT = {"P0": 1.0, "P1": 0.6, "P2": 0.2}
CADENCE_WEIGHT = {"streaming": 1.0, "hourly": 0.8, "daily": 0.5, "weekly": 0.2}
PARTS, FULL, KEPT = (0.5, 0.3, 0.2), 501, 500
#: Fixed values of the suggested actions by label and change.
ACTIONS = [
    ("Dashboard", "rename_column", "Update column reference in BI layer"),
    ("Dashboard", "drop_column", "Remove column usage, update chart definitions"),
    ("Dashboard", "type_change", "Verify formatting and aggregation compatibility"),
    ("MLFeature", "rename_column", "Update feature pipeline and retrain if needed"),
    ("MLFeature", "drop_column", "Remove feature from pipeline, evaluate model impact"),
    ("MLFeature", "type_change", "Validate feature engineering logic for type compatibility"),
    ("Dataset", "rename_column", "Update downstream SELECT and JOIN references"),
    ("Dataset", "drop_column", "Remove column from dependent transforms"),
    ("Transform", "rename_column", "Update SQL / PySpark transform"),
    ("Transform", "drop_column", "Remove column from transform output"),
]


@dataclass(frozen=True)
class SchemaChange:
    dataset: str
    column: str | None = None
    change_type: str = "drop_column"
    new_name: str | None = None
    new_type: str | None = None


def weight(of: Column, table: dict[str, float], default: float) -> Column:
    """A constant for each name."""
    out = None
    for name, value in table.items():
        out = F.when(of == name, value) if out is None else out.when(of == name, value)
    return out.otherwise(F.lit(default))


def score(sla: Column, cadence: Column, fan: Column) -> Column:
    """Tier, cadence and the logarithm of the fan-out, at most 1, with four digits."""
    spread = F.log(fan.cast("double") + 1) / F.log(F.lit(float(FULL)))
    total = weight(sla, SLA_WEIGHT, 0.2) * PARTS[0] + weight(cadence, CADENCE_WEIGHT, 0.5) * PARTS[1] + spread * PARTS[2]
    return F.round(F.least(total, F.lit(1.0)), 4)


def with_actions(assets: DataFrame, change: SchemaChange) -> DataFrame:
    """The action of the asset's label and the change, or a general one."""
    spark = assets.sparkSession
    table = F.broadcast(spark.createDataFrame([(a, c) for a, k, c in ACTIONS if k == change.change_type] or [("", "")], "node_type string, action string"))
    general = f"Review usage of {change.dataset}.{change.column or '*'}"
    return assets.join(table, "node_type", "left").withColumn("suggested_action", F.coalesce("action", F.lit(general))).drop("action")


def flow_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges (src, dst, rel_type) along which a change spreads, from what is stored: consumers read
    datasets, transforms write them, columns and features derive from them."""
    turn = lambda e, kind: e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(kind).alias("rel_type"))
    keep = lambda e, kind: e.select("src", "dst", F.lit(kind).alias("rel_type"))
    of = lambda r: edges.where(F.col("rel_type") == r)
    label = nodes.select(F.col("node_id").alias("src"), "label")
    part = of("PART_OF").join(label, "src")
    runs = nodes.where("label = 'Transform'").select("transform_id", F.col("node_id").alias("run"))
    consumed = of("DERIVES_FROM").join(runs, "transform_id").select(F.col("dst").alias("src"), F.col("run").alias("dst"), F.lit("CONSUMED_BY").alias("rel_type"))
    return (
        turn(of("DERIVES_FROM").where("src <> dst"), "FEEDS").unionAll(turn(of("READS_FROM"), "READ_BY")).unionAll(keep(of("WRITES_TO"), "WRITES_TO"))
        .unionAll(keep(of("PRODUCES"), "PRODUCES")).unionAll(keep(part.where("label = 'Column'"), "COLUMN_OF")).unionAll(keep(part.where("label = 'Transform'"), "RUNS_IN")).unionAll(consumed)
    )


def affected(nodes: DataFrame, edges: DataFrame, starts: DataFrame, semantics: str = "documented", column: bool = True, depth: int = DEPTH) -> DataFrame:
    """(node_id, fan_out) of what a change of the starts reaches.

    as_implemented: along stored edges of all types; fan-out counts incoming dependents, for columns
    without PART_OF. documented: along the flow. A column's change goes from column to column first;
    then the datasets of the reached columns, the transforms that consume, and the dashboards,
    features and pipelines behind those are attached, without spreading to sibling columns.
    """
    edges = stored(edges.select("src", "dst", "rel_type", "transform_id"), "edges", by="rel_type")
    if semantics == "as_implemented":
        reach = bfs(edges.select("src", "dst"), starts, depth)
        rels = [r for r in RELATIONSHIPS if r != "PART_OF"] if column else RELATIONSHIPS
        reach = materialize(reach.select("node_id"), "reached")
        # Only what was reached is counted.
        near = edges.join(reach.select(F.col("node_id").alias("dst")), "dst", "left_semi")
        return materialize(fan_out(reach, near, rels), "affected")
    flow = flow_edges(nodes, edges)
    kinds = lambda *k: flow.where(F.col("rel_type").isin(*k)).select("src", "dst")
    if column:
        cols = materialize(bfs(kinds("FEEDS"), starts, depth).select("node_id"), "reached-columns")
        step = lambda a, e: a.select(F.col("node_id").alias("src")).join(e, "src").select(F.col("dst").alias("node_id"))
        sets = materialize(step(cols, kinds("COLUMN_OF")).distinct(), "reached-datasets")
        # Datasets that hold reached columns, and what consumed the changed or a reached column.
        used = step(cols.unionAll(starts.select("node_id")), kinds("CONSUMED_BY")).distinct()
        readers = step(sets, kinds("READ_BY", "PRODUCES")).distinct()
        users = materialize(used.unionAll(readers).distinct(), "reached-users")
        pipes = step(users, kinds("RUNS_IN")).distinct()
        found = cols.unionAll(sets).unionAll(users).unionAll(pipes).distinct().join(starts, "node_id", "left_anti")
    else:
        found = bfs(kinds("FEEDS", "READ_BY", "WRITES_TO", "PRODUCES", "CONSUMED_BY", "RUNS_IN"), starts, depth).select("node_id")
        found = nodes.where("label <> 'Column'").select("node_id").join(found, "node_id", "left_semi").distinct()
    found = materialize(found, "found")
    # Only what was found is counted.
    own = flow.select("src", "dst").join(found.select(F.col("node_id").alias("src")), "src", "left_semi").distinct()
    fan = own.groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("fan_out"))
    return materialize(found.join(fan, "node_id", "left").select("node_id", F.coalesce("fan_out", F.lit(0)).alias("fan_out")), "affected")


def ranked(nodes: DataFrame, reach: DataFrame, change: SchemaChange, column: bool = True, semantics: str = "documented", kept: int | None = KEPT) -> DataFrame:
    """The affected assets with score, rank and action.

    as_implemented keeps the ``kept`` widest before it scores; documented scores, then keeps; without
    ``kept`` all. Ties go by fan-out and then by id. An unknown tier raises an error.
    """
    labels = LABELS if column else [x for x in LABELS if x != "Column"]
    own = nodes.where(F.col("label").isin(*labels)).join(reach, "node_id")
    tier = F.coalesce("sla_tier", F.lit("P2"))
    assets = own.select(
        "node_id",
        F.col("label").alias("node_type"),
        F.coalesce("name", "dataset", F.lit("")).alias("name"),
        F.when(tier.isin(*SLA_TIERS), tier).otherwise(F.raise_error(F.concat(F.lit("unknown tier "), tier))).alias("sla_tier"),
        F.col("fan_out").alias("downstream_fan_out"),
        F.coalesce("freshness_cadence", F.lit("daily")).alias("freshness_cadence"),
    )
    if semantics == "as_implemented" and kept is not None:
        assets = assets.orderBy(F.desc("downstream_fan_out"), "node_id").limit(kept)
    scored = assets.withColumn("criticality_score", score(F.col("sla_tier"), F.col("freshness_cadence"), F.col("downstream_fan_out")))
    order = [F.desc("criticality_score"), F.desc("downstream_fan_out"), F.col("node_id")]
    top = scored if kept is None else scored.orderBy(*order).limit(kept)
    return with_actions(top, change).orderBy(*order)


def counts(assets: DataFrame, change: SchemaChange) -> DataFrame:
    """One row: total, tiers (K03), labels, and the summary text."""
    label = lambda n: F.count_if(F.col("node_type") == n)
    tier = lambda n: F.count_if(F.col("sla_tier") == n)
    got = assets.agg(F.count(F.lit(1)).alias("total"), tier("P0").alias("p0_count"), tier("P1").alias("p1_count"), label("Dashboard").alias("dashboards"), label("MLFeature").alias("features"), label("Dataset").alias("datasets"))
    got = got.withColumn("p2_count", F.col("total") - F.col("p0_count") - F.col("p1_count"))
    some = lambda c, one: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {one}"), F.when(F.col(c) > 1, F.lit("s")).otherwise(F.lit("")), F.lit(".")))
    of = change.dataset + (f".{change.column}" if change.column else "")
    head = F.concat(F.lit(f"Changing {of} ({change.change_type}) affects "), F.col("total").cast("string"), F.lit(" downstream assets."))
    parts = [some("p0_count", "P0 asset"), some("p1_count", "P1 asset"), some("dashboards", "dashboard"), some("features", "ML feature pipeline"), some("datasets", "downstream dataset")]
    return got.withColumn("summary", F.concat_ws(" ", head, *parts))


def cache_key(change: SchemaChange) -> str:
    """New names and types don't count."""
    said = json.dumps({"dataset": change.dataset, "column": change.column, "change_type": change.change_type}, sort_keys=True)
    return "blast_radius:" + hashlib.sha256(said.encode()).hexdigest()[:16]


class Cache:
    """Values for a time, on the driver."""

    def __init__(self, seconds: float = 900, clock=time.monotonic):
        self.seconds, self.clock, self.held = seconds, clock, {}

    def get(self, key: str):
        at, value = self.held.get(key, (None, None))
        if at is None or self.clock() - at >= self.seconds:
            self.held.pop(key, None)
            return None
        return value

    def put(self, key: str, value) -> None:
        self.held[key] = (self.clock(), value)

    def clear(self) -> int:
        """Forgets every report."""
        n = len(self.held)
        self.held.clear()
        return n


def starts_of(nodes: DataFrame, change: SchemaChange, project: str | None = None) -> DataFrame:
    """The changed column or dataset, in every project unless one is named."""
    own = nodes.where(project is None or F.col("project") == project) if project else nodes
    if change.column is not None:
        return own.where((F.col("label") == "Column") & (F.col("dataset") == change.dataset) & (F.col("name") == change.column)).select("node_id")
    return own.where((F.col("label") == "Dataset") & (F.col("name") == change.dataset)).select("node_id")


def blast_radius(nodes: DataFrame, edges: DataFrame, change: SchemaChange, semantics: str = "documented", cache: Cache | None = None, project: str | None = None) -> dict:
    """The report of a change: assets, provenance, counts, summary and duration (I11). A cached report
    gives its assets under the present change. documented counts all affected assets, as_implemented
    those that are listed."""
    began, key = time.perf_counter(), cache_key(change) + ":" + semantics
    held = cache.get(key) if cache else None
    if held is None:
        edges = stored(edges.select("src", "dst", "rel_type", "transform_id"), "edges", by="rel_type")
        starts, column = materialize(starts_of(nodes, change, project), "starts"), change.column is not None
        reach = affected(nodes, edges, starts, semantics, column)
        assets = materialize(ranked(nodes, reach, change, column, semantics), "assets")
        counted = assets if semantics == "as_implemented" else ranked(nodes, reach, change, column, semantics, kept=None)
        chain = longest_trail(edges, starts, ["READS_FROM", "DERIVES_FROM"], direction="in" if semantics == "as_implemented" else "out")
        held = {"assets": assets, "provenance": chain, "report": counts(counted, change).first().asDict()}
        if cache:
            cache.put(key, held)
    return held | {"change": change, "duration_ms": round((time.perf_counter() - began) * 1000, 2)}


def clicked(node_type: str, name: str, dataset: str | None = None) -> SchemaChange | None:
    """The change that a click on a node asks about; other nodes than columns and datasets ask nothing."""
    if node_type == "Column":
        return SchemaChange(name if dataset is None else dataset, name)
    return SchemaChange(name) if node_type == "Dataset" else None


def asset_paths(nodes: DataFrame, edges: DataFrame, starts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(node_id, path): how a change gets from its start to each asset along the flow."""
    return paths_from(flow_edges(nodes, edges).select("src", "dst"), starts, depth)
