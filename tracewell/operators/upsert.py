"""Lineage events to graph tables, as keyed aggregations.

Records fold in the order (ingested_at, event_id, position): some properties keep their first value,
others take their last, and a key that was seen again has the time it was last seen. What is stored
comes before what is new, so a fold of a fold is the fold of all.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.model import EDGE_SCHEMA, NODE_SCHEMA, names, node_id
from tracewell.runtime import scratch_path

_NODE, _EDGE = names(NODE_SCHEMA), names(EDGE_SCHEMA)


def fold(rows: DataFrame, keys: list[str], first: list[str], last: list[str]) -> DataFrame:
    """One row a key. rows: the columns, ``at`` (time) and ``seq`` (order). Nulls are values too."""
    pick = lambda c, f: f(F.struct(F.col(c).alias("v")), F.col("seq")).alias(f"_{c}")
    got = rows.groupBy(*keys).agg(
        *[pick(c, F.min_by) for c in first], *[pick(c, F.max_by) for c in last],
        F.min("at").alias("created_at"), F.when(F.count(F.lit(1)) > 1, F.max("at")).alias("last_seen_at"),
    )
    return got.select(*keys, *[F.col(f"_{c}.v").alias(c) for c in first + last], "created_at", "last_seen_at")


def prepared(events: DataFrame) -> DataFrame:
    """Events with their effective commit (B10), without repeats of an event id within the batch."""
    own = events.dropDuplicates(["event_id"])
    return own.withColumn("commit", F.coalesce(F.nullif(F.col("commit_id"), F.lit("")), F.col("event_id"))).withColumn("at", F.col("ingested_at"))


def _seq(position: Column) -> Column:
    return F.struct(F.lit(1).alias("new"), F.col("ingested_at").alias("t"), F.col("event_id").alias("e"), position.cast("int").alias("p")).alias("seq")


def dataset_rows(ev: DataFrame) -> DataFrame:
    both = F.concat(F.coalesce("source_datasets", F.array().cast("array<string>")), F.coalesce("target_datasets", F.array().cast("array<string>")))
    x = ev.select("*", F.posexplode(both).alias("pos", "name"))
    return x.select(F.col("project_name").alias("project"), "name", "source_type", F.col("commit").alias("commit_id"), "at", _seq(F.col("pos")))


def column_rows(ev: DataFrame) -> DataFrame:
    x = ev.select("*", F.posexplode("column_derivations").alias("pos", "d"))
    sides = F.array(F.struct(F.col("d.source.dataset").alias("dataset"), F.col("d.source.column").alias("name"), F.lit(0).alias("k")), F.struct(F.col("d.target.dataset").alias("dataset"), F.col("d.target.column").alias("name"), F.lit(1).alias("k")))
    x = x.select("*", F.explode(sides).alias("s"))
    return x.select(F.col("project_name").alias("project"), "s.dataset", "s.name", F.col("commit").alias("commit_id"), "at", _seq(F.col("pos") * 2 + F.col("s.k")), F.col("s.k").alias("side"))


def datasets(ev: DataFrame) -> DataFrame:
    """B01."""
    return fold(dataset_rows(ev), ["project", "name"], ["source_type"], ["commit_id"])


def transforms(ev: DataFrame) -> DataFrame:
    """All but the commit keep their first value."""
    x = ev.select("transform_id", F.col("transform_name").alias("name"), F.col("project_name").alias("project"), "pipeline_name", "source_type", "llm_inferred", "validation_status", "raw_sql", F.col("commit").alias("commit_id"), "at", _seq(F.lit(0)))
    return fold(x, ["transform_id"], ["name", "project", "pipeline_name", "source_type", "llm_inferred", "validation_status", "raw_sql"], ["commit_id"])


def columns(ev: DataFrame) -> DataFrame:
    """B05."""
    return fold(column_rows(ev), ["project", "dataset", "name"], [], ["commit_id"])


def pipelines(ev: DataFrame) -> DataFrame:
    """B08."""
    x = ev.where(F.coalesce("pipeline_name", F.lit("")) != "")
    return fold(x.select(F.col("project_name").alias("project"), F.col("pipeline_name").alias("name"), "source_type", "at", _seq(F.lit(0))), ["project", "name"], ["source_type"], [])


def snapshots(ev: DataFrame) -> DataFrame:
    """One for each event that is written."""
    return ev.select(F.concat_ws("_", "commit", "event_id").alias("name"), F.col("commit").alias("commit_id"), F.col("project_name").alias("project"), "source_type", F.col("at").alias("created_at"))


def write_stats(ev: DataFrame) -> DataFrame:
    """Numbers that a write reports, from the lists' sizes."""
    n = lambda c: F.greatest(F.size(c), F.lit(0))
    return ev.select("event_id", (n("source_datasets") + n("target_datasets") + 1).cast("long").alias("node_count"), (n("source_datasets") + n("target_datasets") + n("column_derivations")).cast("long").alias("rel_count"))


def _wide(df: DataFrame, label: str, *key: str) -> DataFrame:
    df = df.withColumn("label", F.lit(label)).withColumn("node_id", node_id(label, *map(F.col, key)))
    have = dict(zip(_NODE, [x.split()[-1] for x in NODE_SCHEMA.split(", ")], strict=True))
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in have.items()])


def event_nodes(ev: DataFrame) -> DataFrame:
    """All nodes of a batch, in the stored form."""
    return (
        _wide(datasets(ev), "Dataset", "project", "name").unionByName(_wide(columns(ev), "Column", "project", "dataset", "name"))
        .unionByName(_wide(transforms(ev), "Transform", "transform_id")).unionByName(_wide(pipelines(ev), "Pipeline", "project", "name"))
        .unionByName(_wide(snapshots(ev), "Snapshot", "name"))
    )


def reads_writes(ev: DataFrame) -> DataFrame:
    """An edge for each commit, from the transform to its datasets."""
    one = lambda c, r: ev.select("transform_id", "project_name", "commit", "at", F.explode(c).alias("d"), F.lit(r).alias("rel_type"))
    x = one("source_datasets", "READS_FROM").unionAll(one("target_datasets", "WRITES_TO"))
    x = x.select(node_id("Transform", F.col("transform_id")).alias("src"), node_id("Dataset", F.col("project_name"), F.col("d")).alias("dst"), "rel_type", F.col("commit").alias("commit_id"), "at")
    return x.groupBy("src", "dst", "rel_type", "commit_id").agg(F.min("at").alias("created_at"))


def derivations(ev: DataFrame) -> DataFrame:
    """Target to source; the last expression and commit, the first transform and passthrough."""
    x = ev.select("*", F.posexplode("column_derivations").alias("pos", "d"))
    end = lambda s: node_id("Column", F.col("project_name"), F.col(f"d.{s}.dataset"), F.col(f"d.{s}.column"))
    x = x.select(end("target").alias("src"), end("source").alias("dst"), "d.expression", "d.is_passthrough", "transform_id", F.col("commit").alias("commit_id"), "at", _seq(F.col("pos")))
    return fold(x, ["src", "dst"], ["transform_id", "is_passthrough"], ["expression", "commit_id"]).withColumn("rel_type", F.lit("DERIVES_FROM"))


def memberships(ev: DataFrame, semantics: str = "documented", stored: DataFrame | None = None) -> DataFrame:
    """Columns of datasets that the project knows, from the batch or the stored nodes
    (as_implemented: source columns only); transforms of pipelines."""
    cols = column_rows(ev).where("side = 0" if semantics == "as_implemented" else "true").select("project", "dataset", "name").distinct()
    known = dataset_rows(ev).select("project", F.col("name").alias("dataset"))
    if stored is not None:
        known = known.unionAll(stored.where("label = 'Dataset'").select("project", F.col("name").alias("dataset")))
    part = cols.join(known.distinct(), ["project", "dataset"], "left_semi").select(node_id("Column", F.col("project"), F.col("dataset"), F.col("name")).alias("src"), node_id("Dataset", F.col("project"), F.col("dataset")).alias("dst"))
    run = ev.where(F.coalesce("pipeline_name", F.lit("")) != "").select(node_id("Transform", F.col("transform_id")).alias("src"), node_id("Pipeline", F.col("project_name"), F.col("pipeline_name")).alias("dst")).distinct()
    return part.unionAll(run).withColumn("rel_type", F.lit("PART_OF"))


def event_edges(ev: DataFrame, semantics: str = "documented", stored: DataFrame | None = None) -> DataFrame:
    """All edges of a batch, in the stored form; ``stored`` are the nodes that were there before."""
    have = dict(zip(_EDGE, [x.split()[-1] for x in EDGE_SCHEMA.split(", ")], strict=True))
    wide = lambda d: d.select(*[F.col(c) if c in d.columns else F.lit(None).cast(t).alias(c) for c, t in have.items()])
    return wide(reads_writes(ev)).unionAll(wide(derivations(ev))).unionAll(wide(memberships(ev, semantics, stored)))


_NODE_KEYS, _NODE_LAST = ["node_id", "label"], ["commit_id"]
_NODE_FIRST = ["project", "dataset", "name", "transform_id", "pipeline_name", "source_type", "owner", "sla_tier", "freshness_cadence", "llm_inferred", "validation_status", "raw_sql", "created_at"]
_EDGE_KEYS, _EDGE_FIRST, _EDGE_LAST = ["src", "dst", "rel_type", "per"], ["transform_id", "is_passthrough", "created_at"], ["expression", "commit_id"]


def merge_nodes(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored and new nodes as one; a snapshot's key is its name, so writing it again changes nothing."""
    return _merged(stored, new, _NODE_KEYS, _NODE_FIRST, _NODE_LAST)


def _per_commit(edges: DataFrame) -> DataFrame:
    """Reads and writes are kept for each commit, other edges once."""
    return edges.withColumn("per", F.when(F.col("rel_type").isin("READS_FROM", "WRITES_TO"), F.col("commit_id")))


def merge_edges(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored and new edges; reads and writes are kept for each commit, others once."""
    return _merged(_per_commit(stored), _per_commit(new), _EDGE_KEYS, _EDGE_FIRST, _EDGE_LAST).select(*new.columns)


def _merged(stored: DataFrame, new: DataFrame, keys: list[str], first: list[str], last: list[str]) -> DataFrame:
    """Rows of several batches as one a key. Rows without ``seq`` are of one batch; ``stored`` comes first."""
    x = stored.withColumn("seq", F.lit(0)).unionByName(new.withColumn("seq", F.lit(1)))
    return _folded(x, keys, first, last).select(*new.columns)


def _folded(x: DataFrame, keys: list[str], first: list[str], last: list[str]) -> DataFrame:
    pick = lambda c, f: f(F.struct(F.col(c).alias("v")), F.col("seq")).alias(f"_{c}")
    # Seen again: the latest time of all its rows, so that a fold of folds is the fold of all.
    seen = F.when(F.count(F.lit(1)) > 1, F.max(F.coalesce("last_seen_at", "created_at"))).otherwise(F.max("last_seen_at"))
    got = x.groupBy(*keys).agg(*[pick(c, F.min_by) for c in first], *[pick(c, F.max_by) for c in last], seen.alias("last_seen_at"))
    return got.select(*keys, *[F.col(f"_{c}.v").alias(c) for c in first + last], "last_seen_at")


class Conflict(Exception):
    """Another writer committed the version first."""


class GraphStore:
    """Versions of the graph in a folder: each holds what its batch adds (a delta), or all there is (a base).

    A batch's rows are written aside and become a version by one rename (B12), which fails if another
    writer took the version; so a batch writes what it brings and nothing of what is stored. A batch that
    was applied is not applied again, so retries are safe (B14). Readers fold the last base and the deltas
    after it by key, in the order of versions. ``compact`` writes such a fold as a new base; ``apply``
    does so by itself once the deltas after a base are ``fold_after``. A base lies in buckets of a hash of
    the name (nodes) and of the source (edges), sorted within, so that a look-up reads one bucket of it.
    Earlier versions stay readable.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, semantics: str = "documented", tries: int = 5, fold_after: int | None = 16, buckets: int = 16):
        self.spark, self.root, self.semantics, self.tries = spark, root or scratch_path(spark, "graph"), semantics, tries
        self.fold_after, self.buckets = fold_after, buckets

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _conf(self):
        return self.spark._jsparkSession.sessionState().newHadoopConf()

    def _listed(self, folder: str) -> list[str]:
        p = self._path(folder)
        fs = p.getFileSystem(self._conf())
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _log(self) -> list[dict]:
        """The versions in order: version, batch (null for a base that compaction wrote) and buckets (0 for a delta).
        A base's file holds those before it; the newest base that is listed saves reading the earlier files."""
        known = ([""] + self._listed("bases"))[-1]
        names = [n for n in self._listed("versions") if n >= known]
        if not names:
            return []
        said = self.spark.read.schema("version int, batch string, buckets int").json([f"{self.root}/versions/{n}/about" for n in names])
        return [r.asDict() for r in said.distinct().orderBy("version").collect()]

    def versions(self) -> list[tuple[int, str]]:
        """(version, batch) of what was applied."""
        return [(r["version"], r["batch"]) for r in self._log() if r["batch"] is not None]

    def nodes(self, label: str | None = None, name: str | None = None, version: int | None = None) -> DataFrame:
        """All nodes; A06: those of a label or a name, by partition, bucket and row groups; as of a version."""
        keep = [F.col("label") == label] if label is not None else []
        keep += [F.col("name") == name] if name is not None else []
        return self._read("nodes", NODE_SCHEMA, version, keep, name)

    def edges(self, rel_type: str | None = None, src: str | None = None, version: int | None = None) -> DataFrame:
        """All edges, or those of a type or a source; as of a version."""
        keep = [F.col("rel_type") == rel_type] if rel_type is not None else []
        keep += [F.col("src") == src] if src is not None else []
        return self._read("edges", EDGE_SCHEMA, version, keep, src)

    def _read(self, name: str, schema: str, version: int | None, keep: list[Column], key: str | None, fold: bool = True) -> DataFrame:
        log = [r for r in self._log() if version is None or r["version"] <= version]
        start = max([k for k, r in enumerate(log) if r["buckets"]], default=0)
        rows = None
        for kind in (True, False):
            own = [r for r in log[start:] if bool(r["buckets"]) == kind]
            if not own:
                continue
            part = self._scan(own, name, schema)
            for k in keep:
                part = part.where(k)
            if kind and key is not None:
                part = part.where(F.col("bucket") == self._bucket(F.lit(key), own[0]["buckets"]))
            part = part.drop("bucket")
            rows = part if rows is None else rows.unionByName(part)
        if rows is None:
            return self.spark.createDataFrame([], schema)
        if not fold or len(log) - start == 1:
            return rows.drop("seq")
        if name == "nodes":
            return _folded(rows, _NODE_KEYS, _NODE_FIRST, _NODE_LAST).select(*_NODE)
        return _folded(_per_commit(rows), _EDGE_KEYS, _EDGE_FIRST, _EDGE_LAST).select(*_EDGE)

    def _scan(self, versions: list[dict], name: str, schema: str) -> DataFrame:
        """The rows of some versions' files, with their version (seq) and bucket."""
        out = None
        read = self.spark.read.schema(f"{schema}, bucket int")
        for r in versions:
            part = read.parquet(f"{self.root}/versions/v{r['version']:08d}/{name}").withColumn("seq", F.lit(r["version"]))
            out = part if out is None else out.unionByName(part)
        return out

    @staticmethod
    def _bucket(key: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(F.coalesce(key, F.lit(""))), F.lit(buckets)).cast("int")

    def apply(self, events: DataFrame, batch: str, assets: tuple[DataFrame, DataFrame] | None = None) -> bool:
        """Folds a batch of events, and nodes and edges that no event makes, into the store; False if the
        batch was applied before. A writer that finds its version taken folds the batch into the new one."""
        for _ in range(self.tries):
            log = self._log()
            if any(r["batch"] == batch for r in log):
                return False
            try:
                self._apply(events, batch, assets, log)
            except Conflict:
                continue
            last = max([k for k, r in enumerate(log) if r["buckets"]], default=-1)
            if self.fold_after and len(log) - last >= self.fold_after:
                self.compact()
            return True
        raise Conflict(f"batch {batch}: other writers were first {self.tries} times")

    def _apply(self, events: DataFrame, batch: str, assets: tuple[DataFrame, DataFrame] | None, log: list[dict]) -> None:
        ev = prepared(events)
        stored = self._read("nodes", NODE_SCHEMA, None, [F.col("label") == "Dataset"], None, fold=False)
        nodes, edges = event_nodes(ev), event_edges(ev, self.semantics, stored)
        if assets:
            nodes, edges = merge_nodes(nodes, assets[0]), merge_edges(edges, assets[1])
        # A batch is small beside what is stored: as few files as its size needs, searched by the statistics of their row groups.
        self._commit([{"version": len(log) + 1, "batch": batch, "buckets": 0}], nodes.hint("rebalance", "label").sortWithinPartitions("label", "name"), edges.hint("rebalance", "rel_type").sortWithinPartitions("rel_type", "src"), [])

    def compact(self) -> bool:
        """Writes all there is as a new base; False if there is nothing to fold or another writer was first."""
        log = self._log()
        if not log or log[-1]["buckets"]:
            return False
        version = log[-1]["version"]
        lay = lambda df, kind, key: df.withColumn("bucket", self._bucket(F.col(key), self.buckets)).repartition(kind, "bucket").sortWithinPartitions(kind, "bucket", key)
        try:
            self._commit([*log, {"version": len(log) + 1, "batch": None, "buckets": self.buckets}], lay(self.nodes(version=version), "label", "name"), lay(self.edges(version=version), "rel_type", "src"), ["bucket"])
        except Conflict:
            return False
        self._path("").getFileSystem(self._conf()).mkdirs(self._path(f"bases/v{len(log) + 1:08d}"))
        return True

    def _commit(self, log: list[dict], nodes: DataFrame, edges: DataFrame, by: list[str]) -> None:
        """Writes a version, the last of the log, and its part of the log."""
        version = log[-1]["version"]
        draft = f"drafts/{uuid.uuid4().hex}"
        nodes.write.partitionBy("label", *by).parquet(f"{self.root}/{draft}/nodes")
        edges.write.partitionBy("rel_type", *by).parquet(f"{self.root}/{draft}/edges")
        self.spark.createDataFrame(log, "version int, batch string, buckets int").coalesce(1).write.json(f"{self.root}/{draft}/about")
        jvm, fs = self.spark._jvm, self._path("").getFileSystem(self._conf())
        fs.mkdirs(self._path("versions"))
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf())
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(files.makeQualified(self._path(draft)), files.makeQualified(self._path(f"versions/v{version:08d}")), none)
        except Exception as e:
            files.delete(files.makeQualified(self._path(draft)), True)
            if "AlreadyExists" in str(e):
                raise Conflict(f"version {version} is taken") from None
            raise


def replay(events: DataFrame, commit: str | None = None, until=None, semantics: str = "documented") -> tuple[DataFrame, DataFrame]:
    """The graph of the events of a commit or up to a time."""
    ev = prepared(events)
    ev = ev.where(F.col("commit") == commit) if commit is not None else ev
    ev = ev.where(F.col("ingested_at") <= F.lit(until)) if until is not None else ev
    return event_nodes(ev), event_edges(ev, semantics)
