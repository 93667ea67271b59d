"""Schema-registry subjects to lineage events."""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from urllib.request import urlopen

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Avro's simple types by their names in the catalogue.
AVRO_TYPES = {"string": "string", "int": "integer", "long": "bigint", "float": "float", "double": "double", "boolean": "boolean", "bytes": "bytes", "null": "null"}


def topic(subject: Column) -> Column:
    """F03."""
    return F.regexp_replace(subject, "-(value|key)$", "")


def _simple(of: Column) -> Column:
    """The catalogue's name of an Avro branch: a mapped simple type, or the type word of a complex one."""
    word = F.when(of.startswith("{"), F.get_json_object(of, "$.type")).otherwise(of)
    known = F.create_map(*[F.lit(x) for kv in AVRO_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, word), word)


def subject_columns(subjects: DataFrame) -> DataFrame:
    """(subject, version, pos, name, type, nullable, doc) of the schemas.

    Unknown kinds of schema and text that isn't JSON have no columns."""
    kind = F.upper(F.coalesce("schemaType", F.lit("AVRO")))
    avro = subjects.where(kind == "AVRO").select("subject", "version", F.from_json("schema", "fields array<struct<name:string,type:string,doc:string>>").alias("s"))
    avro = avro.select("subject", "version", F.posexplode("s.fields").alias("pos", "f"))
    union = F.from_json("f.type", "array<string>")
    branch = F.when(F.col("f.type").startswith("["), F.get(F.filter(union, lambda x: x != "null"), F.lit(0))).otherwise(F.col("f.type"))
    avro = avro.select("subject", "version", "pos", F.col("f.name").alias("name"), F.coalesce(_simple(branch), F.lit("null")).alias("type"), F.coalesce(F.col("f.type").startswith("[") & F.array_contains(union, "null"), F.lit(False)).alias("nullable"), F.col("f.doc").alias("doc"))
    shape = "properties map<string,struct<type:string,description:string>>, required array<string>"
    js = subjects.where(kind == "JSON").select("subject", "version", F.from_json("schema", shape).alias("s"))
    js = js.select("subject", "version", F.coalesce("s.required", F.array().cast("array<string>")).alias("required"), F.posexplode(F.map_entries("s.properties")).alias("pos", "f"))
    many = F.from_json("f.value.type", "array<string>")
    listed = F.col("f.value.type").startswith("[")
    one = F.when(listed, F.get(F.filter(many, lambda x: x != "null"), F.lit(0))).otherwise(F.col("f.value.type"))
    null = F.when(listed, F.array_contains(many, "null")).otherwise(~F.array_contains("required", F.col("f.key")))
    js = js.select("subject", "version", "pos", F.col("f.key").alias("name"), F.coalesce(one, F.lit("string")).alias("type"), null.alias("nullable"), F.col("f.value.description").alias("doc"))
    return avro.unionAll(js)


def events(subjects: DataFrame, project: str, topics: str | None = None, commit: str | None = None, semantics: str = "documented") -> DataFrame:
    """an event for each subject with columns, whose topic matches ``topics`` anywhere.

    as_implemented derives each column from itself; documented has columns without derivations, so
    they are listed in ``tags``."""
    if topics:
        subjects = subjects.where(topic(F.col("subject")).rlike(topics))
    target = F.concat(F.lit("kafka."), topic(F.col("subject")))
    ref = F.struct(target.alias("dataset"), F.col("name").alias("column"), F.lit("generic").alias("warehouse"))
    own = F.struct("pos", F.struct(ref.alias("source"), ref.alias("target"), F.lit(None).cast("string").alias("expression"), F.lit(True).alias("is_passthrough")).alias("d"))
    grouped = subject_columns(subjects).groupBy("subject", "version").agg(F.array_sort(F.collect_list(own)).alias("ds"), F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "type"))))).alias("types"))
    derived = F.transform("ds", lambda x: x["d"])
    empty = F.filter(derived, lambda x: F.lit(False))
    ident = F.concat(F.lit("kafka_schema_"), "subject", F.lit("_"), F.col("version").cast("string"))
    return grouped.select(
        F.concat(ident, F.lit("@"), F.lit(project)).alias("event_id"), F.lit("kafka").alias("source_type"), F.lit(project).alias("project_name"), F.lit(commit).cast("string").alias("commit_id"), F.current_timestamp().alias("ingested_at"),
        ident.alias("transform_id"), ident.alias("transform_name"), F.lit(None).cast("string").alias("pipeline_name"), F.array().cast("array<string>").alias("source_datasets"), F.array(target).alias("target_datasets"),
        (derived if semantics == "as_implemented" else empty).alias("column_derivations"), F.lit(None).cast("string").alias("raw_sql"), F.col("types").alias("tags"), F.lit(False).alias("llm_inferred"), F.lit("ok").alias("validation_status"),
    )


def http(base: str, timeout: float = 10) -> Callable[[str], object]:
    """``get`` for a registry's address."""

    def get(path: str) -> object:
        with urlopen(base.rstrip("/") + path, timeout=timeout) as answer:
            return json.load(answer)

    return get


def fetch(get: Callable[[str], object], subject_list: str = "/subjects", latest: str = "/subjects/{}/versions/latest", at_once: int = 16) -> list[dict]:
    """All subjects' latest schemas by ``get(path) -> object``, so many at once, in the list's order;
    a failing subject, or one whose answer is no object, is left out; a failing list, or what is no list, is empty."""

    def one(s: str) -> dict | None:
        try:
            got = get(latest.format(s))
        except (OSError, ValueError):
            return None
        if not isinstance(got, dict):
            return None
        return {"subject": s, "version": got.get("version", 1), "schemaType": got.get("schemaType", "AVRO"), "schema": got.get("schema", "")}

    try:
        subjects = get(subject_list)
    except (OSError, ValueError):
        return []
    if not isinstance(subjects, list):
        return []
    with ThreadPoolExecutor(at_once) as pool:
        return [x for x in pool.map(one, subjects) if x]
