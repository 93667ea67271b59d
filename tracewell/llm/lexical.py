"""Ranked lexical search by sort-based accumulation (operator 13).

One pass over the texts keeps, for each document, how often it holds each term that any item asks
for. The counts of those rows give the terms' weights. A task then takes its documents in blocks:
the (item, document, impact) entries of all matched terms are concatenated, their packed keys are
radix sorted, equal keys are summed with reduceat, and an item's sums go through a heap of its best.
A task hands on a heap's worth for each item; Spark merges these.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import arrow_rows, materialize
from tracewell.llm.divergence import slices

#: Words of an item index: what is broadcast at most; more items are searched index by index.
INDEX_WORDS = 2_000_000
#: (item, document, impact) entries that a task sorts at once.
ENTRIES = 1 << 21
#: Documents of a block at most, so that a packed key stays small.
BLOCK = 1 << 12
#: Parts of an item's candidates that are cut to the best before they meet.
PARTS = 64
#: Case is folded for A-Z only; digits stay; every other ASCII character ends a term.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> Iterator[list[bytes]]:
    return slices((text or "").encode("utf-8", "surrogatepass").translate(FOLD))


def radix_order(keys: np.ndarray, bits: int) -> np.ndarray:
    """The stable order of unsigned keys below 2 ** bits, by passes of sixteen bits from the lowest."""
    order = np.argsort(keys.astype(np.uint16), kind="stable")  # numpy's stable sort of 16 bits is a radix sort
    for shift in range(16, bits, 16):
        order = order[np.argsort((keys[order] >> np.uint64(shift)).astype(np.uint16), kind="stable")]
    return order


class Items:
    """The items of an index: for each term, which items ask for it and how often."""

    def __init__(self, items: list[tuple[int | None, Counter]]):
        self.ids = [i for i, _ in items]
        self.terms = {t: k for k, t in enumerate(sorted({t for _, c in items for t in c}))}
        entries = sorted((self.terms[t], k, n) for k, (_, c) in enumerate(items) for t, n in c.items())
        term, self.item, self.times = (np.array(x, dtype=np.int64) for x in zip(*entries, strict=True))
        self.start = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self.weight: np.ndarray | None = None

    def weigh(self, documents: int, df: dict[int, int]) -> None:
        self.weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(self.terms))], dtype=np.int64)


def _indexes(benchmark: DataFrame, item_col: str, text_col: str, most: int) -> Iterator[Items]:
    held, size = {}, 0
    for item, text in benchmark.select(F.col(item_col).cast("long"), F.col(text_col).cast("string")).orderBy(item_col).toLocalIterator():
        own = Counter(w.decode("utf-8", "replace") for part in words(text) for w in part)
        if held and item not in held and size + own.total() > most:
            yield Items(list(held.items()))
            held, size = {}, 0
        if own:
            held.setdefault(item, Counter()).update(own)
            size += own.total()
    if held:
        yield Items(list(held.items()))


def matches(docs: DataFrame, index) -> DataFrame:
    """(doc_id, n, term, tf) for each document with a term: its number of terms, and the index's terms in it
    (arrays of numbers and counts, perhaps empty)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = {t.encode(): k for t, k in index.value.terms.items()}
        for pdf in batches:
            n, found, of = np.zeros(len(pdf), dtype=np.int64), [], []
            for k, text in enumerate(pdf["text"]):
                for part in words(text):
                    n[k] += len(part)
                    found.append(np.array([number[w] for w in part if w in number], dtype=np.int64))
                    of.append(np.full(len(found[-1]), k, dtype=np.int64))
            key, tf = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *of]) << 32 | np.concatenate([np.zeros(0, dtype=np.int64), *found]), return_counts=True)
            cut = np.searchsorted(key >> 32, np.arange(1, len(pdf)))
            out = pd.DataFrame({"doc_id": pdf["doc_id"].array, "n": n, "term": np.split((key & 0xFFFFFFFF).astype(np.int32), cut), "tf": np.split(tf.astype(np.int32), cut)})
            yield out[n > 0]

    return docs.mapInPandas(run, "doc_id long, n long, term array<int>, tf array<int>")


def accumulate(doc: np.ndarray, item: np.ndarray, impact: np.ndarray, docs: int, items: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, doc, score) of the summed entries, by item and document."""
    bits = max(1, (docs - 1).bit_length())
    keys = item.astype(np.uint64) << np.uint64(bits) | doc.astype(np.uint64)
    order = radix_order(keys, bits + max(1, (items - 1).bit_length()))
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=np.int64)
    sums = np.add.reduceat(impact[order], first) if len(first) else np.zeros(0, dtype=np.int64)
    return (keys[first] >> np.uint64(bits)).astype(np.int64), (keys[first] & np.uint64((1 << bits) - 1)).astype(np.int64), sums


def _search(index, norm, top: int):
    """norm: of a document's number of terms, in 64-bit integers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items: Items = index.value
        heaps: list[list[tuple[int, int]]] = [[] for _ in items.ids]

        def block(ids: np.ndarray, n: np.ndarray, size: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
            doc = np.repeat(np.arange(len(ids)), size)
            impact = 1_000_000_000 * tf // (1000 * tf + 8 * norm(n)[doc]) * items.weight[term]
            many = items.start[term + 1] - items.start[term]
            at = np.repeat(items.start[term] - np.cumsum(many) + many, many) + np.arange(many.sum())
            item, doc, score = accumulate(np.repeat(doc, many), items.item[at], np.repeat(impact, many) * items.times[at], len(ids), len(items.ids))
            item, doc, score = (x[score > 0] for x in (item, doc, score))
            cut = np.searchsorted(item, np.arange(len(items.ids) + 1))
            for k in np.flatnonzero(cut[1:] > cut[:-1]):
                heap, mine, of = heaps[k], score[cut[k] : cut[k + 1]], ids[doc[cut[k] : cut[k + 1]]]
                least = np.partition(mine, -top)[-top] if len(mine) > top else 0
                good = mine >= max(least, heap[0][0] if len(heap) == top else 0)
                for entry in zip(mine[good].tolist(), (-of[good]).tolist(), strict=True):
                    if len(heap) < top:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)

        for pdf in batches:
            size = pdf["term"].str.len().to_numpy(dtype=np.int64)
            term, tf = (np.concatenate([np.zeros(0, dtype=np.int64), *pdf[c]]).astype(np.int64) for c in ("term", "tf"))
            ids, n, ends = pdf["doc_id"].to_numpy(dtype=np.int64), pdf["n"].to_numpy(dtype=np.int64), np.append(0, np.cumsum(size))
            entries = np.append(0, np.cumsum(items.start[term + 1] - items.start[term]))[ends]
            at = 0
            while at < len(pdf):
                end = min(at + BLOCK, max(at + 1, int(np.searchsorted(entries, entries[at] + ENTRIES, side="right")) - 1), len(pdf))
                block(ids[at:end], n[at:end], size[at:end], term[ends[at] : ends[end]], tf[ends[at] : ends[end]])
                at = end
        rows = [(items.ids[k], -d, s) for k, heap in enumerate(heaps) for s, d in heap]
        yield pd.DataFrame({"item_id": pd.array([r[0] for r in rows], dtype="Int64"), "doc_id": [r[1] for r in rows], "score": [r[2] for r in rows]})

    return run


def rankings(docs: DataFrame, items: DataFrame, top: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", index_words: int = INDEX_WORDS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``top`` documents with a score above 0, equal ones by doc_id.

    Null or empty texts have no terms: such documents don't count, such items find nothing. The rows of
    one item_id (null too) are one item. Repeated documents each count and rank. A document with a null
    id counts in the statistics and is not ranked, for nothing names it. Whole texts are read, however
    long; other columns are not. No documents or no items: no rows.
    """
    spark = docs.sparkSession
    arrow_rows(spark, 2000)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "item_id long, doc_id long, score long"
    found = spark.createDataFrame([], schema)
    for index in _indexes(items, item_col, item_text, index_words):
        shared = spark.sparkContext.broadcast(index)
        kept = materialize(matches(rows, shared), "lexical-matches")
        documents, length = kept.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = kept.select(F.explode("term").alias("term")).groupBy("term").count()  # at most a row for each of the index's terms
        index.weigh(documents, dict(df.toPandas().itertuples(index=False)))
        weighed = spark.sparkContext.broadcast(index)
        norm = lambda n, documents=documents, length=length: 100 - 75 + 75 * n * documents // length
        found = found.unionAll(kept.where("doc_id is not null").mapInPandas(_search(weighed, norm, top), schema))
    best = lambda by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "doc_id"))
    parts = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))).withColumn("rank", best(["item_id", "part"])).where(F.col("rank") <= top)
    return parts.withColumn("rank", best(["item_id"]).cast("int")).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def op13_lexical_search(spark, sf_dir: str) -> DataFrame:
    return rankings(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def oracle() -> str:
    """DuckDB SQL: the join of all items with all documents over their terms."""
    terms = r"unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
    t AS (SELECT r, doc_id, term, count(*) AS tf FROM (SELECT r, doc_id, {terms} FROM d) GROUP BY r, doc_id, term),
    size AS (SELECT r, sum(tf)::BIGINT AS n FROM t GROUP BY r),
    whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM size),
    weight AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM t, whole GROUP BY term, docs),
    q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {terms} FROM benchmark) GROUP BY item_id, term),
    s AS (SELECT item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // total))))::BIGINT AS score
          FROM q JOIN weight USING (term) JOIN t USING (term) JOIN size USING (r), whole GROUP BY item_id, r, doc_id),
    ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0 AND doc_id IS NOT NULL)
    SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
    """
