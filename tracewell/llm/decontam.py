"""Benchmark decontamination by SimHash over item-sized windows (operator 2).

A window of a document has as many words as a benchmark item; a document of fewer words is one
window as a whole. Windows and items have SimHash
fingerprints of their shingles; the items' fingerprints are indexed by size and by four blocks of 16
bits. Two fingerprints within ``radius`` bits differ in at most a quarter of that in one block, so
looking up each block with that tolerance finds every item within the radius. Candidates are verified
by the exact similarity of the shingles, weighted by how often each occurs.

A window that is similar enough shares most of its shingles with the item. Windows without that
many shingles of any item can't be similar to one, whatever their fingerprint, so no fingerprint is
computed for them; this loses nothing. All other windows, at every word of the whole text, are looked
up. What is lost are similar windows whose fingerprints differ in more than ``radius`` bits: at a
similarity of 0.8 they differ in about 10, and the tests measure the share that is found.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import arrow_rows

WORDS, SIMILAR, RADIUS = 5, 0.8, 22
#: Words of benchmark items that one index holds; more items are searched by several indexes in turn.
INDEX_WORDS = 2_000_000
_TOKEN = re.compile(r"[^\W_]+")
_M = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[str]:
    """Runs of letters and digits, in lower case."""
    return _TOKEN.findall((text or "").lower())


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(ids: np.ndarray, words: int) -> np.ndarray:
    """A hash for each run of ``words`` word numbers."""
    n = len(ids) - words + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(words):
        out *= _M
        out += ids[k : k + n]
    return _mixed(out)


#: Comparisons of a block's values that are held at once.
CELLS = 1 << 20


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)


def similarity(a: Counter, b: Counter) -> float:
    """Shared weight over all weight; a shingle weighs as often as it occurs."""
    both = sum(min(n, b[k]) for k, n in a.items() if k in b)
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


class Table:
    """One block's index: the block's distinct values and the items of each, which are those that differ in ``bits``
    or fewer from what is asked."""

    def __init__(self, blocks: np.ndarray, bits: int):
        self.items = np.argsort(blocks, kind="stable")
        self.values, self.first, self.n = np.unique(blocks[self.items], return_index=True, return_counts=True)
        self.bits = bits

    def near(self, asked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places in ``asked`` and items, some at a time: all asked values are held against the distinct
        values at once, within ``CELLS``."""
        step = max(1, CELLS // len(self.values))
        for low in range(0, len(asked), step):
            a, k = np.nonzero(np.bitwise_count(asked[low : low + step, None] ^ self.values) <= self.bits)
            n = self.n[k]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield np.repeat(a + low, n), self.items[np.repeat(self.first[k], n) + within]


class Index:
    """Benchmark items by word count: shingle sets, fingerprints and block tables."""

    def __init__(self, items: list[tuple[int, str]], words: int = WORDS, similar: float = SIMILAR, radius: int = RADIUS):
        self.words, self.similar, self.radius = words, similar, radius
        self.vocabulary: dict[str, int] = {}
        self.items = [(i, w) for i, t in items if (w := tokens(t))]
        coded = [np.array([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w], dtype=np.uint64) for _, w in self.items]
        self.by_size: dict[int, list[int]] = defaultdict(list)
        self.counts, prints = [], []
        for k, ids in enumerate(coded):
            self.by_size[len(ids)].append(k)
            h = shingle_hashes(ids, min(words, len(ids)))
            self.counts.append(Counter(h.tolist()))
            prints.append(np.packbits(_bits(h).sum(0) * 2 > len(h), bitorder="little").view("<u8")[0])
        self.prints = np.array(prints, dtype=np.uint64)
        self.known = {k: np.unique(np.concatenate([np.array(list(self.counts[i]), dtype=np.uint64) for i in range(len(coded)) if min(words, len(coded[i])) == k])) for k in {min(words, n) for n in self.by_size}}
        self.tables = {size: [Table(b, radius // 4) for b in self._blocks(self.prints[own]).T] for size, own in self.by_size.items()}
        self.least = {k: min(self._least(n, k) for n in self.by_size if min(words, n) == k) for k in self.known}

    def _need(self, size: int, k: int) -> int:
        """J >= s needs a shared weight of 2s/(1+s) of the window's shingles."""
        return int(np.ceil(2 * self.similar / (1 + self.similar) * (size - k + 1) - 1e-9))

    def _least(self, size: int, k: int) -> int:
        """What a window of any size has to share for J >= s: s of the item's shingles."""
        return int(np.ceil(self.similar * (size - k + 1) - 1e-9))

    @staticmethod
    def _blocks(prints: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(prints.astype("<u8")).view("<u2").reshape(-1, 4)

    def lookup(self, size: int, prints: np.ndarray) -> set[tuple[int, int]]:
        """(window, item) pairs within the radius, for items of this size, by the tables of the blocks."""
        own, out = self.by_size[size], set()
        mine = self.prints[own]
        for block, table in zip(self._blocks(prints).T, self.tables[size], strict=True):
            for w, i in table.near(block):
                ok = np.bitwise_count(prints[w] ^ mine[i]) <= self.radius
                out.update((a, own[b]) for a, b in zip(w[ok].tolist(), i[ok].tolist(), strict=True))
        return out

    def search(self, text: str | None) -> list[tuple[int, int, int, float]]:
        """(item, first word, words, similarity) of the best window for each item that the text holds."""
        seen = tokens(text)
        ids = np.fromiter(map(self.vocabulary.get, seen, repeat(0)), dtype=np.uint64, count=len(seen))
        best: dict[int, tuple[float, int, int]] = {}
        told = np.append(0, np.cumsum(ids > 0))
        for k, known in self.known.items():
            # Shingles of known words only; there must be as many as the shortest item needs.
            if len(ids) < k or (told[k:] - told[:-k] == k).sum() < self.least[k]:
                continue
            h = shingle_hashes(ids, k)
            at = np.searchsorted(known, h)
            hit = known[np.minimum(at, len(known) - 1)] == h
            if hit.sum() < self.least[k]:
                continue
            total = np.append(0, np.cumsum(hit))
            for size in self.by_size:
                m = size - k + 1
                if min(self.words, size) != k:
                    continue
                if len(h) < m:
                    # J >= s needs s/(1+s) of both sides' shingles.
                    if total[-1] >= max(self._least(size, k), self.similar / (1 + self.similar) * (len(h) + m) - 1e-9):
                        self._windows(h, np.zeros(1, dtype=np.int64), len(h), size, len(ids), best)
                    continue
                need = self._need(size, k)
                start = np.flatnonzero(total[m:] - total[:-m] >= need)
                if not len(start):
                    continue
                for part in np.array_split(start, max(1, len(start) // 4096)):
                    self._windows(h, part, m, size, size, best)
        return [(self.items[i][0], -p, n, s) for i, (s, p, n) in sorted(best.items())]

    def _windows(self, h: np.ndarray, start: np.ndarray, m: int, size: int, words: int, best: dict) -> None:
        # Bits are summed over stretches, so that distant windows don't cost what lies between.
        cuts = np.flatnonzero(np.diff(start) > m) + 1
        for group in np.split(start, cuts):
            low, high = int(group[0]), int(group[-1]) + m
            sums = np.vstack([np.zeros((1, 64), dtype=np.int32), np.cumsum(_bits(h[low:high]), axis=0)])
            ones = sums[group - low + m] - sums[group - low]
            prints = np.packbits(ones * 2 > m, axis=1, bitorder="little").view("<u8").ravel()
            for w, i in self.lookup(size, prints):
                at = int(group[w])
                s = similarity(Counter(h[at : at + m].tolist()), self.counts[i])
                if s >= self.similar - 1e-12:
                    now = (s, -at, words)
                    best[i] = max(best.get(i, now), now)


def _indexes(benchmark: DataFrame, item_col: str, text_col: str, most: int, **options) -> Iterator[Index]:
    held, size = [], 0
    for r in benchmark.select(item_col, text_col).orderBy(item_col).toLocalIterator():
        n = len(tokens(r[1]))
        if held and size + n > most:
            yield Index(held, **options)
            held, size = [], 0
        held.append((r[0], r[1]))
        size += n
    if held:
        yield Index(held, **options)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", index_words: int = INDEX_WORDS, **options) -> DataFrame:
    """(doc_id, item_id, start, n_words, similarity): the items that a document holds, each with its
    best window, the first of equals; ``start`` counts words from 0. A document of fewer words than
    an item is one window for it.

    Words are runs of letters and digits in lower case. An item of fewer than five words has one
    shingle, all of its words. Items without words, null or empty texts match nothing. Rows with a
    null id are reported under null; repeated rows and items are each reported. No rows: no rows.
    An index holds at most ``index_words`` words; a larger benchmark is searched index by index.
    """
    spark = docs.sparkSession
    arrow_rows(spark, 2000)
    schema = "doc_id long, item_id long, start long, n_words long, similarity double"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for index in _indexes(benchmark, item_col, item_text, index_words, **options):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                got = [(d, *x) for d, t in zip(pdf["doc_id"], pdf["text"], strict=True) for x in shared.value.search(t)]
                yield pd.DataFrame(got, columns=["doc_id", "item_id", "start", "n_words", "similarity"])

        part = rows.mapInPandas(run, schema)
        out = part if out is None else out.unionAll(part)
    return spark.createDataFrame([], schema) if out is None else out


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", index_words: int = INDEX_WORDS, **options) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item, in all their columns.

    Null and empty texts and those with a null id hold none by that; repeated rows stay or go together.
    Whole texts are searched, however long. An empty benchmark leaves all rows. No rows: no rows.
    """
    spark = docs.sparkSession
    arrow_rows(spark, 2000)
    for index in _indexes(benchmark, "item_id", "text", index_words, **options):
        shared = spark.sparkContext.broadcast(index)
        clean = F.pandas_udf(lambda t, shared=shared: pd.Series([not shared.value.search(x) for x in t], dtype=bool), "boolean")
        docs = docs.where(clean(F.col(text_col).cast("string")))
    return docs


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def brute(docs: list[tuple[int, str]], items: list[tuple[int, str]], words: int = WORDS, similar: float = SIMILAR) -> dict[tuple[int, int], tuple[int, float]]:
    """{(doc, item): (first word, similarity)} by comparing every window, for tests; a shorter document is one."""
    grams = lambda w, k: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out: dict[tuple[int, int], tuple[int, float]] = {}
    for d, t in docs:
        w = tokens(t)
        for i, x in items:
            own = tokens(x)
            k = min(words, len(own))
            for at in range(max(1, len(w) - len(own) + 1) if own else 0):
                s = similarity(grams(w[at : at + len(own)], k), grams(own, k))
                if s >= similar - 1e-12 and s > out.get((d, i), (0, 0.0))[1]:
                    out[d, i] = (at, s)
    return out
