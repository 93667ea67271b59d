"""Change capture and ingestion as streams."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tracewell.operators.impact import Cache
from tracewell.operators.upsert import GraphStore
from tracewell.sources.sql_lineage import extract, schema_changes

ENVELOPE = "op string, ts_ms long, source struct<table:string,schema:string,db:string>, after struct<ddl:string,dataset:string,column:string>"
#: Fixed values of the service: how often each kind of job is run again, and seconds before it is.
RETRIES = {"dbt": (3, 10), "spark": (3, 15), "sql": (3, 10), "kafka": (3, 10), "inference": (2, 30)}
#: Fixed values of the service: the pool of each kind of job, others having the default one; seconds a job may take.
POOLS = {"dbt": "dbt", "spark": "spark", "sql": "sql", "kafka": "kafka", "inference": "sql"}
LIMIT = 120
#: What a model's answer must say.
ANSWER = (
    "source_datasets array<string>, target_datasets array<string>, "
    "column_derivations array<struct<source_dataset:string,source_column:string,target_dataset:string,target_column:string,expression:string,is_passthrough:boolean>>, "
    "confidence double, notes string"
)


def decoded(messages: DataFrame, tables: list[str] | None = None) -> DataFrame:
    """The envelopes of messages (column value, text or bytes), with ``tables`` those of the tables
    listed as schema.table. What isn't an envelope gives nulls, and belongs to no table."""
    own = messages.select(F.from_json(F.col("value").cast("string"), ENVELOPE).alias("e")).select("e.*")
    return own if tables is None else own.where(F.concat_ws(".", "source.schema", "source.table").isin(tables))


def envelopes(spark: SparkSession, path: str, tables: list[str] | None = None) -> DataFrame:
    """A stream of JSON files of change envelopes."""
    return decoded(spark.readStream.schema("value string").text(path), tables)


def broker(spark: SparkSession, servers: str, topics: str, tables: list[str] | None = None, **options: str) -> DataFrame:
    """The same as a stream of a broker's topics; needs Spark's Kafka package on the class path."""
    return decoded(spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics).options(**options).load(), tables)


def routed(changes: DataFrame) -> DataFrame:
    """(op, at, dataset, column, ddl, is_alter); deletions have a null ``after``."""
    return changes.select("op", F.timestamp_millis("ts_ms").alias("at"), F.coalesce("after.dataset", "source.table", F.lit("unknown")).alias("dataset"), F.col("after.column").alias("column"), F.col("after.ddl").alias("ddl"), F.coalesce(F.upper("after.ddl").contains("ALTER"), F.lit(False)).alias("is_alter"))


def change_counts(changes: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Changes of each dataset in windows of time; beyond the reference, for watching a stream."""
    return routed(changes).withWatermark("at", late).groupBy(F.window("at", window), "dataset").agg(F.count(F.lit(1)).alias("changes")).select(F.col("window.start").alias("start"), "dataset", "changes")


def apply_changes(changes: DataFrame, cache: Cache, on_change: Callable[[list[dict]], None], checkpoint: str) -> StreamingQuery:
    """Each batch forgets the cached reports and passes on what its statements change."""

    def batch(df: DataFrame, _: int) -> None:
        rows = routed(df).select("ddl", "is_alter").where("ddl is not null")
        if not df.isEmpty():
            cache.clear()
        for r in rows.where("is_alter").toLocalIterator():
            on_change(schema_changes(df.sparkSession, r["ddl"]))

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_events(events: DataFrame, store: GraphStore, checkpoint: str, late: str | None = None) -> StreamingQuery:
    """Events of a stream into the store, a version for each batch. A batch that is tried
    again after a failure is applied once; events may come again within a watermark or a batch."""
    if late:
        events = events.withWatermark("ingested_at", late).dropDuplicatesWithinWatermark(["event_id"])
    return events.writeStream.foreachBatch(lambda df, n: store.apply(df, f"stream{n:08d}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@contextmanager
def bounded(spark: SparkSession, kind: str, seconds: float = LIMIT) -> Iterator[None]:
    """Spark jobs of the block run in the pool of their kind; after so many seconds those that
    run and those that follow are cancelled, which raises in the block."""
    sc, group = spark.sparkContext, f"{kind}-{uuid.uuid4().hex}"
    sc.setJobGroup(group, kind, interruptOnCancel=True)
    sc.setLocalProperty("spark.scheduler.pool", POOLS.get(kind, "default"))
    timer = threading.Timer(seconds, lambda: sc._jsc.sc().cancelJobGroupAndFutureJobs(group))
    timer.daemon = True
    timer.start()
    try:
        yield
    finally:
        timer.cancel()
        for p in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel", "spark.scheduler.pool"):
            sc.setLocalProperty(p, None)


class Jobs:
    """States of ingestion jobs, run again up to ``retries`` times, or as often and as late as their
    kind says (L04, L06)."""

    def __init__(self, retries: int = 3, sleep: Callable[[float], None] = time.sleep):
        self.retries, self.sleep, self.held = retries, sleep, {}

    def run(self, name: str, work: Callable[[], object], kind: str | None = None) -> str:
        retries, wait = RETRIES.get(kind, (self.retries, 0))
        for attempt in range(retries + 1):
            if attempt and wait:
                self.sleep(wait)
            self.held[name] = {"status": "STARTED", "attempt": attempt}
            try:
                self.held[name] = {"status": "SUCCESS", "result": work(), "attempt": attempt}
                break
            except Exception as e:  # noqa: BLE001 - whatever the work raises is its state
                self.held[name] = {"status": "FAILURE", "error": str(e), "attempt": attempt}
        return self.held[name]["status"]

    def status(self, name: str) -> dict:
        return self.held.get(name, {"status": "PENDING"})


class Progress(StreamingQueryListener):
    """Batches and rows of each stream by its id, and how it failed; for ``spark.streams.addListener``."""

    def __init__(self):
        self.held: dict[str, dict] = {}

    def _of(self, stream) -> dict:
        return self.held.setdefault(str(stream), {"batches": 0, "rows": 0, "error": None})

    def onQueryStarted(self, event) -> None:
        self._of(event.id)

    def onQueryProgress(self, event) -> None:
        own = self._of(event.progress.id)
        own["batches"] += 1
        own["rows"] += event.progress.numInputRows

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._of(event.id)["error"] = event.exception


def prompt(sql: str) -> str:
    """What a model is asked."""
    return f"Give the column lineage of the statement as one JSON object of the form {ANSWER}. Confidence lies in 0..1.\n\n{sql}"


def inferences(answers: DataFrame, column: str = "answer") -> DataFrame:
    """The rows with ``inferred``, what a model's answer says. Fences around it don't count.
    Null for a null answer, for what isn't JSON of the form, lacks a part (but expression, passthrough
    and notes), or has a confidence outside of 0..1."""
    bare = F.regexp_replace(column, r"(?m)^\s*```.*$", "")
    got = F.from_json(bare, f"{ANSWER}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    whole = lambda d: d["source_dataset"].isNotNull() & d["source_column"].isNotNull() & d["target_dataset"].isNotNull() & d["target_column"].isNotNull()
    fits = got["_bad"].isNull() & got["source_datasets"].isNotNull() & got["target_datasets"].isNotNull() & F.forall(got["column_derivations"], whole) & got["confidence"].between(0, 1)
    plain = F.transform(got["column_derivations"], lambda d: d.withField("is_passthrough", F.coalesce(d["is_passthrough"], F.lit(False))))
    return answers.withColumn("inferred", F.when(fits, got.dropFields("_bad").withField("column_derivations", plain)))


def with_inference(events: list[dict], infer: Callable[[], dict | None], known: list[str] | None = None) -> list[dict]:
    """An inferred event where parsing found no derivation. Its sources are completed by
    the known ones; confidence lies in 0..1; without an answer the event waits for review."""
    if events and events[0]["column_derivations"]:
        return events
    got = infer()
    base = {"source_datasets": list(known or []), "target_datasets": [], "column_derivations": [], "llm_inferred": True}
    if got is None or not 0 <= got.get("confidence", -1) <= 1:
        return [base | {"validation_status": "pending_review"}]
    sources = [*got.get("source_datasets", []), *[k for k in known or [] if k not in got.get("source_datasets", [])]]
    return [base | got | {"source_datasets": sources, "llm_inferred": True, "validation_status": got.get("validation_status", "ok")}]


def ingest_sql(spark: SparkSession, sql: str, project: str, infer: Callable[[], dict | None] | None = None, **options) -> list[dict]:
    """POST /lineage/ingest/sql: parse, and infer where parsing fails and an inferencer is given."""
    events = extract(spark, sql, project, **options)
    return with_inference(events, infer, options.get("source_datasets")) if infer else events


def ready(spark: SparkSession) -> bool:
    """L11."""
    return spark.sql("select 1").first()[0] == 1
