"""Mixing sources to target weights (operator 1).

The words of a source's documents, one document after the other, make a stream that is packed into
blocks of a fixed number of words. The mix is a row of output shards of a fixed number of slots.
For every shard the counts of slots per source are drawn from a multinomial; a source's slots are
numbered over all shards, and slot ``i`` takes the block at place ``i`` modulo the number of blocks
in the source's pseudorandom order, so blocks repeat only after all others were used. Slots and
blocks meet in a join by index.

Draws stray from the targets by the root of the slots. What a source drew over its need passes, in
order, to the sources that drew too little, and the last slot of each is cut, so that every source
gives its target to the word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import arrow_rows, forget, materialize

WEIGHTS = (1, 2, 3)
MOST, BLOCK, SLOTS, SEED = 3, 64, 1024, 20240601
#: Sources the mix accepts: their totals are held by the driver and by each task.
SOURCES = 100_000
#: Output shards drawn by one row of work, words to a part of a source that is summed apart, and the
#: fewest parts; partitions that the runs are dealt to at most.
RUN, PART_WORDS, PARTS, TASKS = 64, 1 << 26, 64, 16_384


def word_count(text: Column) -> Column:
    """Runs of bytes other than space and the control characters 9 to 13; null: 0."""
    plain = F.trim(F.translate(text, "\t\n\x0b\x0c\r", "     "))
    return F.when(F.coalesce(F.length(plain), F.lit(0)) == 0, F.lit(0)).otherwise(F.size(F.split(plain, " +"))).cast("long")


def share_out(sizes: np.ndarray, weights: np.ndarray, most: int = MOST) -> np.ndarray:
    """Targets: all sizes' sum by weight, none above ``most`` times its size, the excess reshared by weight."""
    total, cap = float(sizes.sum()), sizes.astype(np.float64) * most
    target, open_ = np.zeros(len(sizes)), np.ones(len(sizes), dtype=bool)
    while open_.any():
        left = total - cap[~open_].sum()
        target[open_] = left * weights[open_] / weights[open_].sum()
        over = open_ & (target > cap)
        if not over.any():
            break
        target[over] = cap[over]
        open_ &= ~over
    return target


def _scramble(x: np.ndarray, bits: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """A one-to-one map of the numbers below 2^bits."""
    mask = (np.uint64(1) << bits) - np.uint64(1)
    half = (bits + np.uint64(1)) // np.uint64(2)
    for r in range(4):
        odd = (seed * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03 + 2 * r)) | np.uint64(1)
        x = (x * odd + (seed >> np.uint64(7 * r))) & mask
        x ^= x >> half
    return x


def place(index: np.ndarray, size: np.ndarray, source: np.ndarray, seed: int = SEED) -> np.ndarray:
    """The place of each block in its source's pseudorandom order of ``size`` blocks."""
    size = size.astype(np.uint64)
    bits = np.maximum(1, np.ceil(np.log2(np.maximum(size, 2).astype(np.float64)))).astype(np.uint64)
    key = (source.astype(np.uint64) + np.uint64(seed)) * np.uint64(0xBF58476D1CE4E5B9)
    key ^= key >> np.uint64(29)
    x = _scramble(index.astype(np.uint64), bits, key)
    while (out := x >= size).any():  # walk the cycle back into range
        x[out] = _scramble(x[out], bits[out], key[out])
    return x.astype(np.int64)


class Plan:
    """What is known of each source: its words, target, blocks, slots and where its last slot is cut."""

    def __init__(self, sizes: list[int], block: int, most: int = MOST, seed: int = SEED):
        self.size = np.array(sizes, dtype=np.int64)
        weights = np.array([WEIGHTS[i % len(WEIGHTS)] for i in range(len(sizes))], dtype=np.float64)
        self.target = share_out(self.size, weights, most) if self.size.sum() else np.zeros(len(sizes))
        self.blocks = -(-self.size // block)
        self.words = np.minimum(np.floor(self.target + 0.5).astype(np.int64), most * self.size)
        self.slots, self.cut = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
        for s in np.flatnonzero(self.words):
            n, b = int(self.size[s]), int(self.blocks[s])
            times, rest = divmod(int(self.words[s]), n)
            short = n - (b - 1) * block
            at = int(place(np.array([b - 1]), np.array([b]), np.array([s]), seed)[0])
            slots = -(-rest // block)
            given = lambda k: k * block - (block - short if at < k else 0)  # noqa: B023, E731
            slots += given(slots) < rest
            self.slots[s] = times * b + slots
            # words that the last slot gives; whole passes end with a whole block
            self.cut[s] = rest - given(slots - 1) if slots else block
        self.drawn = self.slots.copy()


def _draws(run: int, total: int, slots: int, p: np.ndarray, seed: int) -> list[np.ndarray]:
    """The multinomial counts of the shards of a run."""
    out = []
    for shard in range(run * RUN, min((run + 1) * RUN, -(-total // slots))):
        rng = np.random.Generator(np.random.Philox(key=[seed, shard]))
        out.append(rng.multinomial(min(slots, total - shard * slots), p))
    return out


def source_sizes(words: DataFrame) -> DataFrame:
    """(source, rank, source_size), a row for each source; ranks by code point, null last."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return words.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("rank", rank.cast("int"))


def mix(items: DataFrame, block: int = BLOCK, slots: int = SLOTS, most: int = MOST, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mixes items (key, source, size) with distinct keys.

    Three tables: sources (source, rank, source_size, target); items (key, source, size, rank, start)
    with the item's place in its source's stream; and takes (key, shard, slot, low, high), the words
    of the item, counted from 0 and without ``high``, that a slot of the mix takes.

    Words of a source are weighted ``WEIGHTS`` by the rank of the source's name, null last. Sources
    without words have target 0. Items of size 0 are taken nowhere. No items: no rows. More than
    ``SOURCES`` sources raise an error. A source's items are summed in parts of some ``PART_WORDS``
    words, so that one large source is many tasks' work. Long items are only numbers here: they
    cover more blocks. Columns of ``items`` other than the three are left out.
    """
    spark = items.sparkSession
    arrow_rows(spark, 10_000)
    items = sizes = materialize(items.select("key", "source", "size"), "mix-sizes")  # texts are read once
    sources = source_sizes(items)
    known = sources.orderBy("rank").limit(SOURCES + 1).collect()
    if len(known) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    plan = Plan([r["source_size"] or 0 for r in known], block, most, seed)
    total = int(plan.slots.sum())
    rows = [(r["source"], i, int(plan.size[i]), float(plan.target[i])) for i, r in enumerate(known)]
    sources = spark.createDataFrame(rows, "source string, rank int, source_size long, target double")

    parts_of = max(PARTS, -(-int(plan.size.sum()) // PART_WORDS))
    part = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(parts_of))
    dealt = materialize(items.join(F.broadcast(sources.select(F.col("source").alias("s"), "rank")), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("part", part), "mix-items")
    before = Window.partitionBy("rank").orderBy("part")
    parts = materialize(dealt.groupBy("rank", "part").agg(F.sum("size").alias("n")).withColumn("base", F.sum("n").over(before) - F.col("n")).drop("n"), "mix-parts")
    inside = Window.partitionBy("rank", "part").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    streams = dealt.withColumn("own", F.sum("size").over(inside) - F.col("size")).join(parts, ["rank", "part"])
    streams = materialize(streams.select("key", "source", "size", "rank", (F.col("base") + F.col("own")).alias("start")), "mix-streams")
    forget(sizes, dealt, parts)

    blocks_of = plan.blocks
    first = F.floor(F.col("start") / block)
    last = F.floor((F.col("start") + F.col("size") - 1) / block)
    pieces = streams.where("size > 0").select("key", "size", "rank", "start", F.explode(F.sequence(first, last)).alias("block"))
    at = F.pandas_udf(lambda rank, index: pd.Series(place(index.to_numpy(), blocks_of[rank.to_numpy()], rank.to_numpy(), seed)), "long")
    pieces = pieces.withColumn("place", at("rank", "block"))

    p = plan.slots / max(total, 1)
    runs = -(-total // (slots * RUN))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for run in pdf["id"]:
                n = np.sum(_draws(int(run), total, slots, p, seed), axis=0)
                some = np.flatnonzero(n)
                yield pd.DataFrame({"run": run, "rank": some.astype(np.int32), "n": n[some]})

    tasks = max(1, min(runs, TASKS))
    drawn = spark.range(0, runs, 1, tasks).mapInPandas(count, "run long, rank int, n long")
    over_runs = Window.partitionBy("rank").orderBy("run")
    drawn = materialize(drawn.withColumn("base", F.sum("n").over(over_runs) - F.col("n")), "mix-draws")
    got = np.zeros(len(known), dtype=np.int64)
    for r in drawn.groupBy("rank").agg(F.sum("n").alias("n")).collect():
        got[r["rank"]] = r["n"]
    over, under = np.maximum(got - plan.slots, 0), np.maximum(plan.slots - got, 0)
    over_base, under_top = np.cumsum(over) - over, np.cumsum(under)
    need, size, cut = plan.slots, plan.size, plan.cut

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for run, base in zip(pdf["run"], pdf["bases"], strict=True):
                at = np.zeros(len(need), dtype=np.int64)
                for b in base:
                    at[b["rank"]] = b["base"]
                for k, n in enumerate(_draws(int(run), total, slots, p, seed)):
                    shard = int(run) * RUN + k
                    rank = np.repeat(np.arange(len(n)), n)
                    index = np.arange(len(rank)) - np.repeat(np.cumsum(n) - n, n) + at[rank]
                    at += n
                    extra = index >= need[rank]
                    spare = over_base[rank[extra]] + index[extra] - need[rank[extra]]
                    to = np.searchsorted(under_top, spare, side="right")
                    rank[extra], index[extra] = to, got[to] + spare - (under_top[to] - under[to])
                    slot = np.random.Generator(np.random.Philox(key=[seed + 1, shard])).permutation(len(rank))
                    width = np.where(index == need[rank] - 1, cut[rank], block)
                    yield pd.DataFrame({"rank": rank.astype(np.int32), "place": index % np.maximum(blocks_of[rank], 1), "width": width, "shard": shard, "slot": slot})

    # The planner would size the partitions by the draws, and each makes RUN * slots slots of them.
    work = drawn.groupBy("run").agg(F.collect_list(F.struct("rank", "base")).alias("bases")).repartitionById(tasks, F.pmod("run", F.lit(tasks)).cast("int"))
    filled = work.mapInPandas(fill, "rank int, place long, width long, shard long, slot long")
    # The planner takes the slots for as few as the draws they come from; they grow with the words.
    met = pieces.hint("merge").join(filled, ["rank", "place"])
    low = F.greatest(F.lit(0), F.col("block") * block - F.col("start"))
    high = F.least(F.col("size"), F.col("block") * block + F.col("width") - F.col("start"))
    takes = met.select("key", "shard", "slot", low.cast("long").alias("low"), high.cast("long").alias("high")).where("high > low")
    return sources, streams, takes


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    """Rows with the same id, source and size are told apart by a number; nulls are a source's name like any other."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return taken_words(docs)


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken), a row for each document."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count(F.col("text")).alias("size"))
    same = rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("copies"))
    items = same.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(F.struct("doc_id", "size", "source", "copy").alias("key"), "source", "size")
    sources, streams, takes = mix(items, **options)
    sums = takes.groupBy("key").agg(F.sum(F.col("high") - F.col("low")).alias("taken"))
    out = streams.join(sums.hint("merge"), "key", "left").join(F.broadcast(sources.drop("source")), "rank")
    return out.select("key.doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents' rows as the mix takes them, with the columns of ``docs``.

    A document that is taken in part keeps the taken words with the white space between neighbours;
    parts that aren't neighbours are joined by a line end. One that is taken again comes again: the
    copies' words are the second and third takes. ``n_chars`` follows the text, if there is one.
    Equal rows count as one with that many copies. Documents without words are not taken. Columns
    named ``__key`` or ``__takes`` are not allowed. No rows: no rows.
    """
    spark = docs.sparkSession
    names = docs.columns
    # Maps and variants can't be hashed, but their JSON can.
    hashed = lambda c: re.search("map<|variant", docs.schema[c].dataType.simpleString())
    plain = [F.to_json(F.struct(F.col(f"`{c}`"))) if hashed(c) else F.col(f"`{c}`") for c in names]
    keyed = docs.withColumn("__key", F.concat_ws("-", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.hex(F.xxhash64(*plain)), F.hex(F.xxhash64(F.lit(7), *plain))))
    rows = keyed.select("__key", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    counted = materialize(rows.groupBy("__key").agg(F.first("source").alias("source"), F.first("size").alias("size"), F.count(F.lit(1)).alias("copies")), "mix-keys")
    items = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(F.struct(F.col("__key").alias("k"), "copy").alias("key"), "source", "size")
    _, _, takes = mix(items, **options)
    spans = takes.groupBy(F.col("key.k").alias("__key"), F.col("key.copy").alias("copy")).agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    per_doc = spans.groupBy("__key").agg(F.collect_list("spans").alias("__takes"))
    # A batch holds its texts, their takes and up to three copies of what these leave.
    arrow_rows(spark, 500)
    others = [c for c in names if c != "text"]
    one = keyed.dropDuplicates(["__key"])
    joined = one.join(per_doc.hint("merge"), "__key").drop("__key")
    cut = F.pandas_udf(lambda text, takes: pd.Series([cut_takes(t, x) for t, x in zip(text, takes, strict=True)]), "array<string>")
    out = joined.withColumn("text", F.explode(cut("text", "__takes"))).drop("__takes")
    if "n_chars" in others:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*names)


def cut_takes(text: str, copies) -> list[str]:
    """The texts that the takes of all copies of a document give: one for each time a word comes again."""
    data = text.encode("utf-8", "surrogatepass")
    solid = np.ones(len(data) + 2, dtype=np.int8)
    raw = np.frombuffer(data, dtype=np.uint8)
    solid[0] = solid[-1] = 0
    solid[1:-1] = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.diff(solid)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out = []
    for spans in copies:
        depth = np.zeros(len(first) + 1, dtype=np.int64)
        for s in spans:
            depth[s["low"]] += 1
            depth[s["high"]] -= 1
        depth = np.cumsum(depth)[:-1]
        for k in range(1, int(depth.max(initial=0)) + 1):
            on = np.diff(np.concatenate([[0], (depth >= k).astype(np.int8), [0]]))
            bits = []
            for a, b in zip(np.flatnonzero(on == 1), np.flatnonzero(on == -1), strict=True):
                begin = 0 if a == 0 else first[a]
                stop = len(data) if b == len(first) else last[b - 1]
                bits.append(data[begin:stop].decode("utf-8", "surrogatepass"))
            out.append("\n".join(bits))
    return out
