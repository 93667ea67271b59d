"""Quality classifier: a generalised additive model with pairwise interactions (operator 5).

Cyclic boosting goes round the features; each turn fits a shallow tree over one feature's bins to
the gradient and adds it, shrunk, to that feature's lookup table. Then the pairs of features that
explain most of what remains get tables of their own in the same way. A score is a sum of looked-up
values, added for all rows of a batch at once.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import arrow_rows

#: Labelled rows the model is fitted on at most: those with the least hash of their id.
FIT_ROWS = 20_000
THRESHOLD = 0.7
FEATURES = ["words", "mean_word", "long_words", "letters", "digits", "upper", "marks", "odd_marks", "spaces", "line_words", "lines", "repeat_lines", "unique_words", "top_word", "short_words", "mark_words", "upper_words", "title_words", "stops", "repeat_pairs", "bars", "entropy"]


def _kinds() -> np.ndarray:
    """For each code point of the basic plane: 1 letter, 2 upper-case letter, 3 digit, 4 space, 5 plain mark, 6 other."""
    out = np.full(1 << 16, 6, dtype=np.uint8)
    for code in range(1 << 16):
        c = chr(code)
        if c.isalpha():
            out[code] = 2 if c.isupper() else 1
        elif c.isdigit():
            out[code] = 3
        elif c.isspace():
            out[code] = 4
        elif c in ".,;:!?'\"()-":
            out[code] = 5
    return out


_KIND: list[np.ndarray] = []


def features(text: str | None) -> list[float]:
    """Of the whole text. Null texts count as empty."""
    t = text or ""
    n = max(len(t), 1)
    if not _KIND:
        _KIND.append(_kinds())
    code = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = _KIND[0][np.minimum(code, 0xFFFF)]
    tally = np.bincount(kind, minlength=7)
    solid = np.zeros(len(code) + 2, dtype=np.int8)
    solid[1:-1] = kind != 4
    edge = np.diff(solid)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    size, m = last - first + 1, max(len(first), 1)
    capital = np.append(0, np.cumsum(kind == 2))
    small = np.append(0, np.cumsum(kind == 1))
    shouted = (capital[last + 1] - capital[first] > 0) & (small[last + 1] == small[first])
    low = t.lower().split()
    counts = Counter(low)
    lines = [x for x in t.split("\n") if x.strip()]
    letters = int(tally[1] + tally[2])
    share = np.unique(code, return_counts=True)[1] / n if len(code) < 512 else np.bincount(np.minimum(code, 0xFFFF))
    share = share[share > 0] / (1 if len(code) < 512 else n)
    pairs = len(set(zip(low, low[1:], strict=False)))
    return [
        float(np.log1p(len(first))),
        float(size.sum()) / m,
        float((size > 12).sum()) / m,
        letters / n,
        int(tally[3]) / n,
        int(tally[2]) / max(letters, 1),
        int(tally[5] + tally[6]) / n,
        int(tally[6]) / n,
        int(tally[4]) / n,
        m / max(len(lines), 1),
        float(np.log1p(len(lines))),
        1 - len(set(lines)) / max(len(lines), 1),
        len(counts) / m**0.75,
        max(counts.values(), default=0) / m,
        float((size <= 2).sum()) / m,
        float((kind[last] >= 4).sum()) / m,
        float(shouted.sum()) / m,
        float((kind[first] == 2).sum()) / m,
        t.count(". ") / m,
        1 - pairs / (len(low) - 1) if len(low) > 1 else 0.0,
        t.count("|") / n,
        float(-(share * np.log(share)).sum()),
    ]


def matrix(texts: Iterator[str | None]) -> np.ndarray:
    rows = [features(t) for t in texts]
    return np.array(rows, dtype=np.float64).reshape(len(rows), len(FEATURES))


def _tree(grad: np.ndarray, weight: np.ndarray, leaves: int, floor: float) -> np.ndarray:
    """A step function over ordered bins with a few leaves, by greedy splits of the gradient sums."""
    g, h = np.append(0, np.cumsum(grad)), np.append(0, np.cumsum(weight))
    parts = [(0, len(grad))]
    gain = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1.0)
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for a, b in parts:
            if b - a > 1:
                at = np.arange(a + 1, b)
                ok = (h[at] - h[a] >= floor) & (h[b] - h[at] >= floor)
                won = np.where(ok, gain(a, at) + gain(at, b) - gain(a, b), -1)
                k = int(won.argmax())
                if won[k] > best[0]:
                    best = (won[k], (a, b), int(at[k]))
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(grad))
    for a, b in parts:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1.0)
    return out


class Gam:
    """Lookup tables over bins of features and of pairs of features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, bins: int = 48, coarse: int = 8, cycles: int = 150, pair_cycles: int = 60, pairs: int = 8, rate: float = 0.15, leaves: int = 3):
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(len(FEATURES))]
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        self.coarse = [c[:: max(1, len(c) // coarse)][:coarse] for c in self.cuts]
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []
        rate_y = (y.sum() + 1.0) / (len(y) + 2.0)
        self.base = float(np.log(rate_y / (1 - rate_y)))
        if not len(x) or y.min() == y.max():
            return
        own = self._bins(x)
        f = np.full(len(y), self.base)
        for _ in range(cycles):
            for j in range(len(FEATURES)):
                p = 1 / (1 + np.exp(-f))
                size = len(self.tables[j])
                step = rate * _tree(np.bincount(own[j], y - p, size), np.bincount(own[j], p * (1 - p), size), leaves, 0.5)
                self.tables[j] += step
                f += step[own[j]]
        near = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.coarse)]
        p = 1 / (1 + np.exp(-f))
        won = []
        for i in range(len(FEATURES)):
            for j in range(i + 1, len(FEATURES)):
                wide = len(self.coarse[j]) + 1
                cell = near[i] * wide + near[j]
                g, h = np.bincount(cell, y - p), np.bincount(cell, p * (1 - p))
                won.append((-float((g * g / (h + 1.0)).sum()), i, j))
        for _, i, j in sorted(won)[:pairs]:
            self.pairs.append((i, j))
            self.pair_tables.append(np.zeros((len(self.coarse[i]) + 1) * (len(self.coarse[j]) + 1)))
        for _ in range(pair_cycles):
            for k, (i, j) in enumerate(self.pairs):
                a, b = len(self.coarse[i]) + 1, len(self.coarse[j]) + 1
                cell = near[i] * b + near[j]
                p = 1 / (1 + np.exp(-f))
                g = np.bincount(cell, y - p, a * b).reshape(a, b)
                h = np.bincount(cell, p * (1 - p), a * b).reshape(a, b)
                # A tree of depth two: a split of one feature, then one of the other in each half.
                top = _tree(g.sum(1), h.sum(1), 2, 0.5)
                cut = int(np.argmax(top != top[0])) or a
                step = np.zeros((a, b))
                for part in (slice(0, cut), slice(cut, a)):
                    if h[part].size:
                        step[part] = _tree(g[part].sum(0), h[part].sum(0), 2, 0.5)
                step = rate * step.ravel()
                self.pair_tables[k] += step
                f += step[cell]

    def _bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)]

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        for table, own in zip(self.tables, self._bins(x), strict=True):
            f += table[own]
        near = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.coarse)]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            f += table[near[i] * (len(self.coarse[j]) + 1) + near[j]]
        return 1 / (1 + np.exp(-f))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Gam:
    """The model of at most ``rows`` labelled documents that aren't held out.

    Labels that are null or aren't 0 or 1 don't count; several labels of a document count as their
    mean, from one half on as 1. Without both labels every score is the smoothed share of label 1.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out())
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    arrow_rows(docs.sparkSession, 2000)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["doc_id"], "label": pdf["label"], "x": list(matrix(pdf["text"]))})

    texts = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").mapInPandas(run, "key long, label int, x array<double>")
    got = texts.toPandas()
    got["order"] = [zlib.crc32(repr((int(k), list(x))).encode()) for k, x in zip(got["key"], got["x"], strict=True)]
    got = got.sort_values(["order", "key"]).head(rows)
    x = np.array(got["x"].tolist(), dtype=np.float64) if len(got) else np.zeros((0, len(FEATURES)))
    return Gam(x, got["label"].to_numpy(dtype=np.float64))


def with_scores(docs: DataFrame, model: Gam, text_col: str = "text", to: str = "score") -> DataFrame:
    """The documents with a score from 0 to 1, higher where label 1 is likelier, in the column ``to``.

    Whole texts are scored, however long; null and empty ones too, as texts without features. Repeated rows
    have equal scores. A column ``to`` that is there is replaced; ``free_name`` finds one that isn't. No rows:
    no rows.
    """
    arrow_rows(docs.sparkSession, 2000)
    score = F.pandas_udf(lambda t: pd.Series(model.score(matrix(t))), "double")
    return docs.withColumn(to, score(F.col(text_col).cast("string")))


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = with_scores(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
