"""Catalogue reports over nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.model import LABELS
from tracewell.operators.traverse import bfs, hops

def rows() -> Column:  # a column needs a session
    return F.count(F.lit(1))


def _of(nodes: DataFrame, label: str, prefix: str, *cols: str) -> DataFrame:
    return nodes.where(F.col("label") == label).select(F.col("node_id").alias(f"{prefix}_id"), *[F.col(c).alias(f"{prefix}_{c}") for c in cols])


def _rel(edges: DataFrame, rels: list[str], src: str, dst: str) -> DataFrame:
    return edges.where(F.col("rel_type").isin(*rels)).select(F.col("src").alias(src), F.col("dst").alias(dst))


def node_stats(nodes: DataFrame) -> DataFrame:
    """H01."""
    return nodes.groupBy("label").agg(rows().alias("n")).orderBy(F.desc("n"), "label")


def edge_stats(edges: DataFrame) -> DataFrame:
    """H02."""
    return edges.groupBy("rel_type").agg(rows().alias("n")).orderBy(F.desc("n"), "rel_type")


def stats_shares(stats: DataFrame) -> DataFrame:
    """Total, largest and each count's share of the largest, in whole percent."""
    whole = stats.agg(F.sum("n").alias("total"), F.max("n").alias("largest"))
    return stats.crossJoin(F.broadcast(whole)).withColumn("share", F.when(F.col("largest") > 0, F.floor(F.lit(100) * F.col("n") / F.col("largest") + 0.5)).otherwise(F.lit(0)).cast("long"))


def graph_nodes(nodes: DataFrame, project: str | None = None, limit: int = 500) -> DataFrame:
    """The first nodes by id, of a project if one is named."""
    own = nodes.where(F.col("label").isin(*LABELS))
    if project is not None:
        own = own.where(F.col("project") == project)
    return own.select("node_id", "label", "name", "project").orderBy("node_id").limit(limit)


def graph_edges(nodes: DataFrame, edges: DataFrame, limit: int = 500) -> DataFrame:
    """The first edges whose ends are both of the six labels."""
    known = nodes.where(F.col("label").isin(*LABELS)).select("node_id")
    own = edges.select("src", "dst", "rel_type").distinct()
    own = own.join(known.select(F.col("node_id").alias("src")), "src", "left_semi").join(known.select(F.col("node_id").alias("dst")), "dst", "left_semi")
    return own.select("src", "dst", "rel_type").orderBy("src", "dst", "rel_type").limit(limit)


def datasets(nodes: DataFrame, edges: DataFrame, project: str | None = None, source_type: str | None = None) -> DataFrame:
    """Datasets with the number of transforms that read or write them."""
    own = _of(nodes, "Dataset", "d", "name", "project", "source_type")
    own = own.where(F.col("d_project") == project) if project is not None else own
    own = own.where(F.col("d_source_type") == source_type) if source_type is not None else own
    used = _rel(edges, ["READS_FROM", "WRITES_TO"], "t_id", "d_id").join(_of(nodes, "Transform", "t"), "t_id", "left_semi").distinct()
    n = used.groupBy("d_id").agg(rows().alias("n"))
    return own.join(n, "d_id", "left").select(F.col("d_name").alias("name"), F.col("d_project").alias("project"), F.col("d_source_type").alias("source_type"), F.coalesce("n", F.lit(0)).alias("transform_count")).orderBy(F.desc("transform_count"), "name")


def dataset_columns(nodes: DataFrame, edges: DataFrame, dataset: str | None = None, project: str | None = None) -> DataFrame:
    """Columns with the number of columns that derive from them directly."""
    own = _of(nodes, "Column", "c", "name", "dataset", "project")
    own = own.where(F.col("c_dataset") == dataset) if dataset is not None else own
    own = own.where(F.col("c_project") == project) if project is not None else own
    n = _rel(edges, ["DERIVES_FROM"], "k_id", "c_id").distinct().groupBy("c_id").agg(rows().alias("n"))
    return own.join(n, "c_id", "left").groupBy(F.col("c_dataset").alias("dataset"), F.col("c_name").alias("name")).agg(F.sum(F.coalesce("n", F.lit(0))).alias("downstream_count"))


def asset_metadata(nodes: DataFrame, edges: DataFrame, dataset: str) -> DataFrame:
    """A dataset's transforms and the dashboards within three reads; no row for an unknown one."""
    own = _of(nodes.where(F.col("name") == dataset), "Dataset", "d", "name", "owner", "sla_tier", "freshness_cadence").orderBy("d_id").limit(1)
    t = _rel(edges, ["READS_FROM", "WRITES_TO"], "t_id", "d_id").join(_of(nodes, "Transform", "t"), "t_id", "left_semi").join(own.select("d_id"), "d_id", "left_semi").agg(F.count_distinct("t_id").alias("transform_count"))
    near = bfs(hops(edges, ["READS_FROM"], "in"), own.select(F.col("d_id").alias("node_id")), 3)
    s = near.join(_of(nodes, "Dashboard", "s").select(F.col("s_id").alias("node_id")), "node_id", "left_semi").agg(rows().alias("dashboard_count"))
    return own.crossJoin(F.broadcast(t)).crossJoin(F.broadcast(s)).select(F.col("d_name").alias("name"), F.coalesce("d_owner", F.lit("")).alias("owner"), F.coalesce("d_sla_tier", F.lit("P2")).alias("sla_tier"), F.coalesce("d_freshness_cadence", F.lit("daily")).alias("freshness_cadence"), "transform_count", "dashboard_count")


def tier_dashboards(nodes: DataFrame, edges: DataFrame, tier: str = "P0", semantics: str = "documented") -> DataFrame:
    """Dashboards of a tier with the datasets behind them, sorted and joined.

    as_implemented looks for datasets read by transforms that the dashboard reads; documented also
    takes those that it reads itself."""
    own = _of(nodes.where(F.col("sla_tier") == tier), "Dashboard", "s", "name", "owner")
    reads = _rel(edges, ["READS_FROM"], "a", "b").distinct()
    sets = _of(nodes, "Dataset", "d", "name")
    via = reads.alias("x").join(_of(nodes, "Transform", "t").select(F.col("t_id").alias("b")), "b", "left_semi").select(F.col("a").alias("s_id"), F.col("b").alias("m")).join(reads.select(F.col("a").alias("m"), F.col("b").alias("d_id")), "m").select("s_id", "d_id")
    direct = reads.select(F.col("a").alias("s_id"), F.col("b").alias("d_id"))
    found = via if semantics == "as_implemented" else via.unionAll(direct)
    names = found.join(own.select("s_id"), "s_id", "left_semi").join(sets, "d_id").groupBy("s_id").agg(F.array_join(F.array_sort(F.collect_set("d_name")), ",").alias("datasets"))
    return own.join(names, "s_id", "left").select(F.col("s_name").alias("name"), F.coalesce("datasets", F.lit("")).alias("datasets")).orderBy("name")


def orphans(nodes: DataFrame, edges: DataFrame, least: int = 5) -> DataFrame:
    """H09 (at least), H15 (with ``least`` one higher): datasets without an owner that many transforms use."""
    own = _of(nodes.where(F.coalesce("owner", F.lit("")) == ""), "Dataset", "d", "name", "project")
    used = _rel(edges, ["READS_FROM", "WRITES_TO"], "t_id", "d_id").join(_of(nodes, "Transform", "t"), "t_id", "left_semi").distinct()
    return used.join(own, "d_id").groupBy("d_id", "d_name", "d_project").agg(rows().alias("dep_count")).where(F.col("dep_count") >= least).select(F.col("d_name").alias("name"), F.col("d_project").alias("project"), "dep_count").orderBy(F.desc("dep_count"), "name")


def lineage_history(nodes: DataFrame, edges: DataFrame, dataset: str, limit: int = 10, semantics: str = "documented") -> DataFrame:
    """The last snapshots; documented takes those whose commit touches the dataset."""
    snaps = _of(nodes, "Snapshot", "x", "name", "commit_id", "created_at", "project")
    if semantics == "documented":
        own = _of(nodes.where(F.col("name") == dataset), "Dataset", "d")
        touched = _rel(edges, ["READS_FROM", "WRITES_TO"], "t_id", "d_id").join(own, "d_id", "left_semi").join(_of(nodes, "Transform", "t", "commit_id"), "t_id").select(F.col("t_commit_id").alias("x_commit_id")).distinct()
        snaps = snaps.join(touched, "x_commit_id", "left_semi")
    return snaps.orderBy(F.desc("x_created_at"), "x_name").limit(limit).select(F.col("x_name").alias("snapshot"), F.col("x_commit_id").alias("commit_id"), F.col("x_created_at").alias("created_at"))


def many_sources(nodes: DataFrame, edges: DataFrame, over: int = 3) -> DataFrame:
    """Columns that derive from more than so many columns."""
    n = _rel(edges, ["DERIVES_FROM"], "c_id", "k_id").distinct().groupBy("c_id").agg(rows().alias("source_count")).where(F.col("source_count") > over)
    return n.join(_of(nodes, "Column", "c", "name", "dataset"), "c_id").select(F.col("c_dataset").alias("dataset"), F.col("c_name").alias("column"), "source_count").orderBy(F.desc("source_count"), "dataset", "column")


def inferred_transforms(nodes: DataFrame, flagged: bool = False) -> DataFrame:
    """Transforms with inferred lineage, the newest first."""
    own = nodes.where((F.col("label") == "Transform") & F.col("llm_inferred"))
    own = own.where(F.col("validation_status") == "flagged") if flagged else own
    return own.select("name", "pipeline_name", "project", "created_at").orderBy(F.desc("created_at"), "name")


def models_reading(nodes: DataFrame, edges: DataFrame, source: str, source_type: str = "dbt") -> DataFrame:
    """Transforms of a kind that read a dataset."""
    d = _of(nodes.where(F.col("name") == source), "Dataset", "d")
    t = _of(nodes.where(F.col("source_type") == source_type), "Transform", "t", "name", "pipeline_name")
    return _rel(edges, ["READS_FROM"], "t_id", "d_id").join(d, "d_id", "left_semi").join(t, "t_id").select(F.col("t_name").alias("model"), F.col("t_pipeline_name").alias("pipeline")).distinct().orderBy("model")


def pipeline_dashboards(nodes: DataFrame, edges: DataFrame, tier: str = "P0") -> DataFrame:
    """For each pipeline the dashboards of a tier that read a dataset which its transforms read or write."""
    part = _rel(edges, ["PART_OF"], "t_id", "l_id").join(_of(nodes, "Pipeline", "l", "name"), "l_id")
    sets = _rel(edges, ["WRITES_TO", "READS_FROM"], "t_id", "d_id")
    pairs = part.join(sets, "t_id").select("l_name", "d_id").distinct()
    own = _rel(edges, ["READS_FROM"], "s_id", "d_id").join(_of(nodes.where(F.col("sla_tier") == tier), "Dashboard", "s"), "s_id", "left_semi").distinct()
    return pairs.join(own, "d_id").select("l_name", "s_id").distinct().groupBy(F.col("l_name").alias("pipeline")).agg(rows().alias("dashboards"))


def shared_datasets(nodes: DataFrame, edges: DataFrame, dashboard: str) -> DataFrame:
    """Pipelines that write a dataset which a dashboard reads, with the dataset; without repeats."""
    seen = _rel(edges, ["READS_FROM"], "s_id", "d_id").join(_of(nodes.where(F.col("name") == dashboard), "Dashboard", "s"), "s_id", "left_semi").select("d_id")
    used = _rel(edges, ["READS_FROM", "WRITES_TO"], "t_id", "d_id").join(seen, "d_id", "left_semi")
    pipes = _rel(edges, ["PART_OF"], "t_id", "l_id").join(_of(nodes, "Pipeline", "l", "name"), "l_id")
    return used.join(pipes, "t_id").join(_of(nodes, "Dataset", "d", "name"), "d_id").select(F.col("l_name").alias("pipeline"), F.col("d_name").alias("dataset")).distinct()


def transforms_per_project(nodes: DataFrame) -> DataFrame:
    return nodes.where("label = 'Transform'").groupBy("project").agg(rows().alias("transforms"))


def wide_transforms(nodes: DataFrame, edges: DataFrame, over: int = 1) -> DataFrame:
    """Transforms that read more than so many datasets."""
    n = _rel(edges, ["READS_FROM"], "t_id", "d_id").distinct().groupBy("t_id").agg(rows().alias("sources")).where(F.col("sources") > over)
    return n.join(_of(nodes, "Transform", "t", "name"), "t_id").select(F.col("t_name").alias("transform"), "sources")


def missing_columns(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(dataset, column) pairs that the catalogue lacks; stars aren't looked up."""
    known = nodes.where("label = 'Column'").select("dataset", F.col("name").alias("column"))
    return wanted.where("column <> '*'").select("dataset", "column").distinct().join(known, ["dataset", "column"], "left_anti")
