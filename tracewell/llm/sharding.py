"""Sharding by size-tiered compaction (operator 9). DataFrame operations only.

A store is a folder of immutable Parquet shards and of numbered manifests, each the list of the
shards that make up the store at that version. An arrival is appended as small shards, without a
shuffle. Compaction puts the shards of a manifest into tiers by size, cuts each tier into runs of
about the target's size, and rewrites runs of several shards as one. Shards of half the target or more stay.
A version counts once its manifest's folder gets its name, in one rename that fails if the name is
taken; whoever fails left only files that no manifest lists.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm.common import forget, materialize, scratch_path

#: Bytes of a finished shard, rows of an arriving one, and how many times larger each tier is.
TARGET, SMALL_ROWS, FAN = 64 << 20, 2000, 4
_MANIFEST = "path string, folder string, rows long, bytes long, level int"


class Conflict(Exception):
    """Another writer committed the version first."""


class Store:
    def __init__(self, spark: SparkSession, root: str, target: int = TARGET, small_rows: int = SMALL_ROWS, fan: int = FAN):
        self.spark, self.root = spark, root.rstrip("/")
        self.target, self.small_rows, self.fan = target, small_rows, fan

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _conf(self):
        return self.spark._jsparkSession.sessionState().newHadoopConf()

    def version(self) -> int:
        """The last version; 0 before any."""
        p = self._path("manifests")
        fs = p.getFileSystem(self._conf())
        if not fs.exists(p):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return max([int(n[1:]) for n in names if n[:1] == "v"], default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """(path, folder, rows, bytes, level), a row for each shard."""
        v = self.version() if version is None else version
        if not v:
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifests/v{v:08d}")

    def commit(self, shards: DataFrame, version: int) -> int:
        """Makes the shards the given version, or raises Conflict."""
        draft = f"draft-{uuid.uuid4().hex}"
        shards.select("path", "folder", "rows", "bytes", "level").write.parquet(f"{self.root}/manifests/{draft}")
        jvm, to = self.spark._jvm, self._path(f"manifests/v{version:08d}")
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.getFileSystem(self._conf()).getUri(), self._conf())
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(files.makeQualified(self._path(f"manifests/{draft}")), files.makeQualified(to), none)
        except Exception as e:
            files.delete(self._path(f"manifests/{draft}"), True)
            if "AlreadyExists" in str(e):
                raise Conflict(f"version {version} is taken") from None
            raise
        return version

    def _written(self, folder: str, level: int) -> DataFrame:
        """The shards of a folder, as manifest rows. Only row counts are read."""
        rows = self.spark.read.parquet(f"{self.root}/{folder}")
        meta = rows.metadataColumn("_metadata")
        files = rows.select(meta["file_path"].alias("path"), meta["file_size"].alias("bytes"))
        return files.groupBy("path").agg(F.count(F.lit(1)).alias("rows"), F.max("bytes").alias("bytes")).select("path", F.lit(folder).alias("folder"), "rows", "bytes", F.lit(level).alias("level"))

    def append(self, docs: DataFrame) -> int:
        """Writes an arrival as small shards and commits them beside the present ones."""
        base, folder = self.version(), f"data/arrival-{uuid.uuid4().hex}"
        docs.write.option("maxRecordsPerFile", self.small_rows).option("compression", "zstd").parquet(f"{self.root}/{folder}")
        return self.commit(self.manifest(base).unionByName(self._written(folder, 0)), base + 1)

    def plan(self, shards: DataFrame) -> DataFrame:
        """(path, folder, run): the shards to merge and the number of the run each is merged into."""
        tier = F.greatest(F.lit(0), F.floor(F.log(F.greatest(F.col("bytes"), F.lit(1)) / F.lit(float(self.target))) / F.log(F.lit(float(self.fan)))) + 16)
        small = shards.where(F.col("bytes") * 2 < self.target).withColumn("tier", tier)
        before = F.sum("bytes").over(Window.partitionBy("tier").orderBy("path")) - F.col("bytes")
        runs = small.withColumn("part", F.floor(before / self.target))
        many = runs.groupBy("tier", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        # A number for each run, from 0: the window holds a row a run.
        many = many.select("tier", "part", (F.row_number().over(Window.orderBy("tier", "part")) - 1).alias("run"))
        return runs.join(many, ["tier", "part"]).select("path", "folder", "run")

    def compact(self) -> int:
        """Merges runs of similar shards and commits the result; the same version if there are none."""
        base = self.version()
        shards = self.manifest(base)
        plan = materialize(self.plan(shards), "shard-plan")
        runs = plan.select("run").distinct().count()
        if not runs:
            return base
        folders = [f"{self.root}/{r['folder']}" for r in plan.select("folder").distinct().toLocalIterator()]
        rows = [self.spark.read.parquet(f) for f in folders]
        path, run = _fresh({c for r in rows for c in r.columns}, "path", "run")
        whole = None
        for r in rows:
            r = _with_file(r, path)
            whole = r if whole is None else whole.unionByName(r, allowMissingColumns=True)
        moved = whole.join(plan.select(F.col("path").alias(path), F.col("run").alias(run)), path).drop(path)
        folder = f"data/run-{uuid.uuid4().hex}"
        # Each run has a partition of its own and becomes the partition's one file.
        moved.repartitionById(runs, run).drop(run).write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
        level = shards.agg(F.max("level")).first()[0] + 1
        kept = shards.join(plan.select("path"), "path", "left_anti").select("path", "folder", "rows", "bytes", "level")
        version = self.commit(kept.unionByName(self._written(folder, level)), base + 1)
        forget(plan)
        return version

    def read(self, version: int | None = None, shard: str = "shard") -> DataFrame:
        """All rows of a version, with the shard each is in, in a column named ``shard``, which must not be a stored column's name."""
        v = self.version() if version is None else version
        shards = self.manifest(v)
        out = None
        for r in shards.select("folder").distinct().orderBy("folder").toLocalIterator():
            part = _with_file(self.spark.read.parquet(f"{self.root}/{r['folder']}"), shard)
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        if out is None:
            raise ValueError("the store is empty")
        return out.join(shards.select(F.col("path").alias(shard)), shard, "left_semi")


def _with_file(rows: DataFrame, path: str) -> DataFrame:
    """The rows with the path of the file each is in; a stored column may be named like the metadata's."""
    return rows.select("*", rows.metadataColumn("_metadata")["file_path"].alias(path))


def _fresh(taken: set[str], *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes to be no column's."""
    low, out = {c.lower() for c in taken}, []
    for name in names:
        while name in low:
            name = f"_{name}"
        out.append(name)
    return out


def shard_documents(docs: DataFrame, root: str | None = None, **options) -> DataFrame:
    """Appends the documents to a store, compacts it, and returns (doc_id, shard, shard_rows,
    shard_bytes, version), a row for each row of the store.

    Null ids and texts, very long texts and repeated rows are stored as they are, and so are columns
    of any name. No rows: no rows, and a manifest without shards. Shards are named by their place
    below the store's folder. Without a ``root`` the store is a scratch folder, deleted when the driver ends.
    """
    spark = docs.sparkSession
    store = Store(spark, root or scratch_path(spark, "shards"), **options)
    store.append(docs)
    while (now := store.version()) != store.compact():
        pass
    shards = store.manifest(now)
    if shards.isEmpty():
        return spark.createDataFrame([], "doc_id long, shard string, shard_rows long, shard_bytes long, version int")
    sizes = shards.select(F.col("path").alias("shard"), F.col("rows").alias("shard_rows"), F.col("bytes").alias("shard_bytes"))
    [shard] = _fresh(set(docs.columns), "shard")
    rows = store.read(now, shard).select("doc_id", F.col(shard).alias("shard")).join(sizes, "shard")
    return rows.select("doc_id", F.regexp_extract("shard", "/(data/.*)$", 1).alias("shard"), "shard_rows", "shard_bytes", F.lit(now).alias("version"))


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
