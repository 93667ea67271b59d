"""The lineage model: enumerations, schemas and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the model.
LABELS = ["Dataset", "Column", "Transform", "Pipeline", "Dashboard", "MLFeature"]
RELATIONSHIPS = ["READS_FROM", "WRITES_TO", "DERIVES_FROM", "PART_OF", "PRODUCES"]
SOURCE_TYPES = ["dbt", "spark", "sql", "kafka", "manual"]
CHANGE_TYPES = ["rename_column", "drop_column", "type_change", "rename_table", "drop_table", "add_column"]
SLA_TIERS = ["P0", "P1", "P2"]
WAREHOUSES = ["redshift", "bigquery", "snowflake", "postgres", "generic"]
CADENCES = ["streaming", "hourly", "daily", "weekly"]
STATUSES = ["ok", "flagged", "pending_review"]

_REF = "struct<dataset:string,column:string,warehouse:string>"
EVENT_SCHEMA = (
    "event_id string, source_type string, project_name string, commit_id string, ingested_at timestamp, transform_id string, "
    "transform_name string, pipeline_name string, source_datasets array<string>, target_datasets array<string>, "
    f"column_derivations array<struct<source:{_REF},target:{_REF},expression:string,is_passthrough:boolean>>, "
    "raw_sql string, tags string, llm_inferred boolean, validation_status string"
)
NODE_SCHEMA = (
    "node_id string, label string, project string, dataset string, name string, transform_id string, pipeline_name string, "
    "source_type string, owner string, sla_tier string, freshness_cadence string, llm_inferred boolean, validation_status string, "
    "raw_sql string, commit_id string, created_at timestamp, last_seen_at timestamp"
)
EDGE_SCHEMA = (
    "src string, dst string, rel_type string, commit_id string, transform_id string, expression string, is_passthrough boolean, "
    "created_at timestamp, last_seen_at timestamp"
)


def names(schema: str) -> list[str]:
    """The top-level column names of a schema text."""
    out, depth, word = [], 0, ""
    for c in schema + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(word.split()[0])
            word = ""
        else:
            word += c
    return out


def node_id(label: str | Column, *key: Column) -> Column:
    """A stable id of a label and its natural key; nulls and separators in the key can't collide."""
    parts = [F.lit(label) if isinstance(label, str) else label, *key]
    return F.sha2(F.to_json(F.array(*[F.coalesce(p.cast("string"), F.lit("\u0000")) for p in parts])), 256)


def normalise(name: Column) -> Column:
    """white space, then double quotes, then back quotes off both ends."""
    plain = F.regexp_replace(name, r"^\s+|\s+$", "")
    return F.regexp_replace(F.regexp_replace(plain, '^"+|"+$', ""), "^`+|`+$", "")
