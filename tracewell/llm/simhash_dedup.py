"""SimHash near-duplicates by anchor-point covering (operator 10).

The anchors are the words of a covering code: the direct sum of nine (7,4) Hamming codes and one
free bit. Each block of seven bits has exactly one code word within one bit, so every 64-bit
point has one nearest anchor. A fingerprint goes to the anchor of every point within half the
threshold of it; two fingerprints within the threshold have a point between them, so they meet at
that point's anchor. All of these anchors lie within the covering radius plus the threshold; the
other anchors of that ball can't be needed and are left out. Fingerprints are compared per anchor.

Crowded anchors are not compared pairwise. Their fingerprints are replicated once more, to all
points within half the threshold; a point is near at most 65 fingerprints, whatever the data, and
those are all within the threshold of each other, so links to the least of them keep the
components whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import arrow_rows, connected_components, materialize

BITS, BLOCKS = 64, 9
#: Fingerprints at an anchor up to which they are compared pairwise.
CROWD = 64


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of one text, unsigned; no words: zero."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    if len(w) < words:
        w, words = [b" ".join(w)], 1
    ones, total = np.zeros(BITS, dtype=np.int64), len(w) - words + 1
    for at in range(0, total, 1 << 15):
        part = w[at : min(at + (1 << 15), total) + words - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(words)), strict=False)) if words > 1 else part
        h = np.array([xxhash.xxh64_intdigest(g, seed) for g in grams], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(texts: pd.Series, words: int) -> np.ndarray:
    return np.fromiter((fingerprint(t, words) for t in texts), dtype=np.uint64, count=len(texts)).view(np.int64)


def _hamming_home() -> np.ndarray:
    """For each of the 128 words of seven bits, the code word within one bit of it."""
    syndrome = lambda v: np.bitwise_xor.reduce([i + 1 for i in range(7) if v >> i & 1] or [0])
    return np.array([v ^ (1 << s - 1) if (s := int(syndrome(v))) else v for v in range(128)], dtype=np.uint64)


HOME = _hamming_home()


def home_anchor(points: np.ndarray) -> np.ndarray:
    """The anchor nearest to each unsigned 64-bit point."""
    out = points & np.uint64(1 << 63)
    for i in range(BLOCKS):
        shift = np.uint64(7 * i)
        out |= HOME[(points >> shift) & np.uint64(127)] << shift
    return out


def ball(points: np.ndarray, radius: int) -> np.ndarray:
    """One row per point: all words within the radius of it."""
    flips = [np.zeros(1, dtype=np.uint64)]
    one = np.uint64(1) << np.arange(BITS, dtype=np.uint64)
    for _ in range(radius):
        flips.append(np.unique(flips[-1][:, None] ^ one[None, :]))
    return points[:, None] ^ np.unique(np.concatenate(flips))[None, :]


def anchors(points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) pairs without repeats: the anchors of all words within the radius."""
    homes = np.sort(home_anchor(ball(points, radius)), axis=1)
    new = np.ones(homes.shape, dtype=bool)
    new[:, 1:] = homes[:, 1:] != homes[:, :-1]
    row, _ = np.nonzero(new)
    return row, homes[new]


def links(fps: DataFrame, threshold: int = 2) -> DataFrame:
    """Links (src, dst) whose components are those of all pairs of the distinct fingerprints
    (column fp) at the threshold or fewer differing bits."""
    half = (threshold + 1) // 2

    def replicate(points):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for at in range(0, len(pdf), 4096):
                    fp = pdf["fp"].to_numpy()[at : at + 4096]
                    row, to = points(fp.view(np.uint64))
                    yield pd.DataFrame({"fp": fp[row], "anchor": to.view(np.int64)})

        return run

    def whole_ball(fp):
        b = ball(fp, half)
        return np.repeat(np.arange(len(fp)), b.shape[1]), b.ravel()

    reps = fps.select("fp").mapInPandas(replicate(lambda fp: anchors(fp, half)), "fp long, anchor long")
    cells = materialize(reps.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "cells")
    shared = materialize(reps.join(cells, "anchor"), "shared")
    pairs = (
        shared.where(F.col("n") <= CROWD).groupBy("anchor").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
        .select("fps", F.explode("fps").alias("y"))
        .select(F.col("y").alias("src"), F.explode(F.expr(f"filter(fps, x -> x > y and bit_count(x ^ y) <= {threshold})")).alias("dst"))
    )
    dense = shared.where(F.col("n") > CROWD).select("fp").distinct().mapInPandas(replicate(whole_ball), "fp long, anchor long")
    points = dense.groupBy("anchor").agg(F.array_sort(F.collect_list("fp")).alias("fps")).where("size(fps) > 1")
    if threshold % 2:
        close = points.select("fps", F.explode("fps").alias("y")).select(F.col("y").alias("src"), F.explode(F.expr(f"filter(fps, x -> x > y and bit_count(x ^ y) <= {threshold})")).alias("dst"))
    else:
        close = points.select(F.col("fps")[0].alias("src"), F.explode(F.expr("slice(fps, 2, size(fps))")).alias("dst"))
    return pairs.unionAll(close).distinct()


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, threshold: int = 2) -> DataFrame:
    """(doc_id, fp, component_id), a row for each input row.

    component_id is the least id that is reachable over links of fingerprints at ``threshold`` or
    fewer differing bits. Null or blank texts have fingerprint zero and link like any other. Rows
    with a null id get their component's least id. Repeated rows stay. No rows give no rows.
    """
    arrow_rows(docs.sparkSession, 2000)
    udf = F.pandas_udf(lambda t: pd.Series(fingerprints(t, words)), "long")
    own = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), udf(F.col(text_col)).alias("fp")), "fingerprints")
    least = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "least")
    label = connected_components(links(least, threshold), "fp-components")
    linked = label.select(F.col("node").alias("fp"), "component").join(least, "fp")
    of = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    moved = materialize(linked.select("fp", "component").join(of, "component").select("fp", "component_id"), "moved")
    final = materialize(least.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "classes")
    return own.join(final, "fp").select("doc_id", "fp", "component_id")


def op10_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
