"""Chat formatting by rotating perspectives (operator 3). DataFrame operations only.

Every speaker of a dialogue is the assistant once: the dialogue is rendered with that speaker's turns
as the assistant's, the other speakers as users by name, and a mask that trains on the assistant's
turns alone. Narrators (the system) speak in every rendering and are nobody's perspective.

Dialogues are rendered in parts of ``PART`` turn numbers, so no group grows with a dialogue's length;
a rendering is its parts in order, and each turn, a narrator's too, stands in the part of its number
only. To train on a part alone, put the narrator's opening turn of part 0 before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART = 64
NARRATORS = ("system",)
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def perspectives(turns: DataFrame, part: int = PART, narrators: tuple[str, ...] = NARRATORS) -> DataFrame:
    """(conv_id, perspective, part, n_turns, text, mask, n_trained), a row for each speaker and part.

    mask: lengths of text and whether they are trained on, as ``length:flag`` joined by commas; the
    assistant's words and closing mark are trained on, never the headings. Turns go by turn, role and
    text, null turns first, in the part before the others. A null role is a speaker with an empty
    name, a null text an empty text, a null conv_id a dialogue of its own. Equal rows are one turn
    that was delivered again: they are rendered once. Marks within texts are broken up by a space. A
    dialogue of narrators only has one rendering with a null perspective and nothing to train on.
    """
    clean = F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("<|im_"), F.lit("< |im_"))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    said = turns.select("conv_id", F.coalesce(F.floor(F.col("turn") / part), F.lit(-1)).cast("long").alias("part"), F.struct(F.col("turn").cast("long").alias("turn"), role.alias("name"), clean.alias("text")).alias("t"))
    parts = said.groupBy("conv_id", "part").agg(F.array_sort(F.collect_set("t")).alias("turns"))
    narrates = F.col("t.name").isin(*narrators) if narrators else F.lit(False)
    # A null speaker stands for the narrators; it is rendered only where it is alone.
    who = said.groupBy("conv_id", F.when(~narrates, F.col("t.name")).alias("perspective")).agg(F.lit(1).alias("x")).drop("x")
    alone = who.groupBy(F.col("conv_id").alias("c")).agg(F.count("perspective").alias("speakers"))
    who = who.join(alone, F.col("conv_id").eqNullSafe(F.col("c"))).where("perspective is not null or speakers = 0").select(F.col("conv_id").alias("c"), "perspective")
    met = parts.join(who, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    told = ", ".join(f"'{n}'" for n in narrators) or "null"
    head = f"concat('{OPEN}', case when t.name <=> perspective then 'assistant' when t.name in ({told}) then t.name else concat('user name=', t.name) end, '\\n')"
    pieces = met.withColumn("p", F.expr(f"transform(turns, t -> struct({head} as head, concat(t.text, '{CLOSE}', '\\n') as body, cast(t.name <=> perspective as int) as flag))"))
    return pieces.select(
        "conv_id",
        "perspective",
        "part",
        F.size("turns").cast("long").alias("n_turns"),
        F.expr("array_join(transform(p, x -> concat(x.head, x.body)), '')").alias("text"),
        F.expr("array_join(transform(p, x -> concat(length(x.head), ':0,', length(x.body), ':', x.flag)), ',')").alias("mask"),
        F.expr("cast(aggregate(p, 0, (n, x) -> n + x.flag * length(x.body)) as bigint)").alias("n_trained"),
    )


def op3_chat_format(spark, sf_dir: str) -> DataFrame:
    return perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def oracle() -> str:
    told = ", ".join(f"'{n}'" for n in NARRATORS)
    return f"""
    WITH t AS (SELECT DISTINCT conv_id, coalesce(floor(turn / {PART}.0), -1)::BIGINT AS part, turn, coalesce(role, '') AS name,
        replace(coalesce(text, ''), '<|im_', '< |im_') AS text FROM conversations),
    w AS (SELECT DISTINCT conv_id, CASE WHEN name NOT IN ({told}) THEN name END AS perspective FROM t),
    v AS (SELECT * FROM (SELECT *, count(perspective) OVER (PARTITION BY conv_id) AS speakers FROM w) WHERE perspective IS NOT NULL OR speakers = 0),
    m AS (SELECT t.*, perspective, CASE WHEN name = perspective THEN 1 ELSE 0 END AS flag,
        '{OPEN}' || CASE WHEN name = perspective THEN 'assistant' WHEN name IN ({told}) THEN name ELSE 'user name=' || name END || chr(10) AS head,
        text || '{CLOSE}' || chr(10) AS body FROM t JOIN v ON t.conv_id IS NOT DISTINCT FROM v.conv_id)
    SELECT conv_id, perspective, part, count(*) AS n_turns, string_agg(head || body, '' ORDER BY turn NULLS FIRST, name, text) AS text,
        string_agg(length(head) || ':0,' || length(body) || ':' || flag, ',' ORDER BY turn NULLS FIRST, name, text) AS mask,
        sum(flag * length(body))::BIGINT AS n_trained
    FROM m GROUP BY conv_id, perspective, part"""
