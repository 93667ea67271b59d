"""Tables between steps: written to the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one in a local session only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tracewell-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(p)
    return path


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Writes the rows, in a folder for each value of ``by``, and reads them back: the lineage is cut by
    files that outlive any executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """The materialized rows and their number, which the write itself counts."""
    seen = Observation()
    out = materialize(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return out, seen.get["n"]


def dealt(df: DataFrame, by: str, rows: int) -> DataFrame:
    """The rows dealt to tasks by a key, some ``rows`` to a task: for small rows that grow much in what follows,
    which a file's splits don't tell."""
    return df.repartition(df.count() // rows + 1, by)


@contextmanager
def by_shuffled_size(spark: SparkSession, tasks: int = 1) -> Iterator[None]:
    """Joins that are run within are broadcast by the size of what was shuffled alone, for files of repeating texts
    are many times smaller than their rows; shuffles have at least so many tasks, which are merged up to 16 MB of
    compressed rows."""
    limit = spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) or spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    tasks = max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    given = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": limit, "spark.sql.shuffle.partitions": str(tasks), "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m"}
    before = {k: spark.conf.get(k, None) for k in given}
    for k, v in given.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Nodes of plans that only read: running such a plan again costs a scan.
_SCANS = {"LogicalRelation", "LocalRelation", "Project", "Filter", "Union"}


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """The rows for many reads: as they are if they are scanned from files, else written once."""
    plans = [df._jdf.queryExecution().optimizedPlan()]
    while plans:
        plan = plans.pop()
        if plan.nodeName().split()[0] not in _SCANS and not plan.nodeName().startswith("Relation"):
            return materialize(df, name, by)
        plans += [plan.children().apply(i) for i in range(plan.children().size())]
    return df


#: The paths of materialized tables that are still in use.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def hand_over(table: DataFrame, view: DataFrame) -> DataFrame:
    """The view of a materialized table, which from now on stands for its files."""
    if path := _PATHS.pop(table, None):
        _PATHS[view] = path
    return view


def forget(*tables: DataFrame | None) -> None:
    """Deletes the files of materialized tables that nothing reads any more; other tables are left alone."""
    for df in tables:
        if df is not None and (path := _PATHS.pop(df, None)):
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers once, for those that can't import it themselves."""
    import os
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_tracewell_shipped", False):
        return
    sc._tracewell_shipped = True
    root = os.path.dirname(os.path.abspath(__file__))
    to = os.path.join(tempfile.mkdtemp(prefix="tracewell-"), "tracewell.zip")
    with zipfile.ZipFile(to, "w") as z:
        for d, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    p = os.path.join(d, f)
                    z.write(p, os.path.join("tracewell", os.path.relpath(p, root)))
    sc.addPyFile(to)
