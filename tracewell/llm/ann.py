"""Nearest neighbours by score-aware anisotropic quantisation (operator 8).

Vectors are scaled to length one, so that the inner product is the cosine. A coarse stage deals them
to cells, each to its nearest centre; a query goes to as many cells as a sample of queries needs for
nearly all of its true neighbours. So a vector is shipped and encoded once, and hot cells are cut
into blocks.

Within a block vectors are cut into subspaces of two dimensions with 16 centres each, fitted on a bounded
sample. The loss weighs the part of a residual that is parallel to the vector ``eta`` times as much as
the rest, since it moves the scores of the queries that have the vector among their nearest. Codes
are four bits, two to a byte; a block is scanned with a table of 256 sums for each byte, and the best
fiftieth of the scan is scored exactly, in double precision, on the original vectors. What its last
place leaves open is scored exactly too: all vectors that could reach it, given the size of their
quantisation error along and across the vector. So a group of near copies, whose codes tie, loses none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import arrow_rows, materialize

SUB, CENTRES = 2, 16
#: Rows the centres are fitted on, vectors to a cell on average and to a block, queries to a block.
SAMPLE, CELL, BLOCK, QUERIES = 20_000, 2048, 8192, 16_384
#: Share of a block that is scored exactly whatever the bounds say, and the least number.
SHARE, LEAST = 0.02, 32
#: Queries of the sample that the number of probed cells is fitted on, and the share of true neighbours they must find.
TRIED, RECALL = 256, 0.995
#: More than single precision loses in a scan score.
ROUNDING = 1e-5


class Quantiser:
    def __init__(self, vectors: np.ndarray, eta: float = 2.6, rounds: int = 8, seed: int = 7):
        """vectors: of length one, a row each."""
        rng = np.random.default_rng(seed)
        n, self.dim = vectors.shape
        self.parts = -(-self.dim // SUB)
        self.parts += self.parts % 2
        self.eta = eta
        x = self._cut(vectors)
        if not n:
            self.centres = np.zeros((self.parts, CENTRES, SUB))
            return
        start = rng.integers(0, n, (self.parts, CENTRES))
        self.centres = np.stack([x[start[p], p] for p in range(self.parts)]).astype(np.float64)
        for _ in range(rounds):
            codes = self.encode(vectors)
            for p in range(self.parts):
                # The weighted loss of a centre c over its vectors: |x-c|^2 + (eta-1) <x-c, u>^2 with
                # u the vector's part, for the whole vector has length one; its zero is linear in c.
                for k in range(CENTRES):
                    own = x[codes[:, p] == k, p].astype(np.float64)
                    if len(own):
                        a = len(own) * np.eye(SUB) + (eta - 1) * own.T @ own
                        b = own.sum(0) + (eta - 1) * (own * (own**2).sum(1, keepdims=True)).sum(0)
                        self.centres[p, k] = np.linalg.solve(a, b)

    def _cut(self, v: np.ndarray) -> np.ndarray:
        out = np.zeros((len(v), self.parts * SUB), dtype=np.float32)
        out[:, : self.dim] = v
        return out.reshape(len(v), self.parts, SUB)

    def encode(self, vectors: np.ndarray, passes: int = 2) -> np.ndarray:
        """Codes by coordinate descent: the parallel error couples the subspaces."""
        x = self._cut(vectors)
        c = self.centres.astype(np.float32)
        inner = np.einsum("nps,pks->npk", x, c)
        square = (c**2).sum(2)[None] - 2 * inner + (x**2).sum(2)[:, :, None]
        codes = square.argmin(2)
        along = (x**2).sum(2)[:, :, None] - inner  # what each choice leaves along the vector
        rows = np.arange(len(x))
        total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
        for _ in range(passes):
            for p in range(self.parts):
                rest = total - along[rows, p, codes[:, p]]
                loss = square[:, p] + (self.eta - 1) * (rest[:, None] + along[:, p]) ** 2
                codes[:, p] = loss.argmin(1)
                total = rest + along[rows, p, codes[:, p]]
        return codes.astype(np.uint8)

    def errors(self, vectors: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The length of each vector's quantisation error along the vector and across it."""
        x = self._cut(vectors).astype(np.float64)
        e = x - self.centres[np.arange(self.parts), codes]
        along = (x * e).sum((1, 2))
        return along, np.sqrt(np.maximum((e * e).sum((1, 2)) - along**2, 0))

    def pack(self, codes: np.ndarray) -> np.ndarray:
        return codes[:, ::2] | codes[:, 1::2] << 4

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """For each query and byte of code the sum of both halves' inner products."""
        t = np.einsum("qps,pks->qpk", self._cut(queries), self.centres.astype(np.float32))
        return (t[:, ::2, None, :] + t[:, 1::2, :, None]).reshape(len(queries), self.parts // 2, 256)


def exact_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cosines of one vector with rows, in double precision."""
    return (c @ q) / (np.sqrt((c * c).sum(1)) * np.sqrt((q * q).sum()))


def could_reach(score: np.ndarray, least: float, along: np.ndarray, across: np.ndarray) -> np.ndarray:
    """Which vectors can have a cosine of ``least`` or more with the query, given their scan scores.

    With cosine c and error e a vector u scores c - <q, e>, and <q, e> = c <u, e> + r, where r is at
    most sqrt(1 - c^2) times the error across u. For c >= 0 and <u, e> <= 1 the least score for c
    grows with c.
    """
    if least <= 0:
        return np.ones(len(score), dtype=bool)
    return (along > 1) | (score >= least * (1 - along) - np.sqrt(max(0.0, 1 - least * least)) * across - ROUNDING)


class Cells:
    """The coarse stage: centres of cells, and how many cells a query visits."""

    def __init__(self, vectors: np.ndarray, cells: int, top: int = 5, rounds: int = 6, seed: int = 11):
        """vectors: of length one, a row each, a sample of all."""
        cells = max(1, min(cells, len(vectors) // 4))
        rng = np.random.default_rng(seed)
        self.centres = vectors[rng.permutation(len(vectors))[:cells]].astype(np.float32) if len(vectors) else np.zeros((1, vectors.shape[1]), dtype=np.float32)
        for _ in range(rounds if cells > 1 else 0):
            home = self.ranked(vectors, 1)[:, 0]
            for c in np.unique(home):
                mean = vectors[home == c].sum(0)
                self.centres[c] = mean / max(np.sqrt((mean * mean).sum()), 1e-12)
        self.probes = 1 if cells == 1 else self._probes(vectors, top)

    def ranked(self, vectors: np.ndarray, most: int) -> np.ndarray:
        """The nearest cells of each vector, nearest first, ties to the first."""
        out = np.zeros((len(vectors), most), dtype=np.int32)
        for at in range(0, len(vectors), 4096):
            out[at : at + 4096] = np.argsort(-(vectors[at : at + 4096] @ self.centres.T), axis=1, kind="stable")[:, :most]
        return out

    def _probes(self, vectors: np.ndarray, top: int) -> int:
        """The fewest cells that hold ``RECALL`` of the sample's true neighbours of some of its rows."""
        asked = vectors[:TRIED]
        score = asked @ vectors.T
        score[np.arange(len(asked)), np.arange(len(asked))] = -2
        true = np.argpartition(-score, min(top, score.shape[1] - 1), axis=1)[:, :top]
        home = self.ranked(vectors, 1)[:, 0]
        order = self.ranked(asked, len(self.centres))
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1], dtype=np.int32)[None, :], axis=1)
        at = np.take_along_axis(place, home[true], axis=1)
        found = np.cumsum(np.bincount(at.ravel(), minlength=len(self.centres))) / at.size
        return int(np.searchsorted(found, RECALL)) + 1


def search_block(model: Quantiser, qid: np.ndarray, q: np.ndarray, vid: np.ndarray, v: np.ndarray, top: int, share: float = SHARE, finish: bool = True) -> list[tuple[int, int, float]]:
    """For each query its best of the block: (query, vec_id, score). Without ``finish`` only the best
    ``share`` of the scan is scored."""
    order = np.argsort(vid, kind="stable")
    vid, v = vid[order], v[order]
    _, first, same = np.unique(v.view(f"V{v.dtype.itemsize * v.shape[1]}").ravel(), return_index=True, return_inverse=True)
    lists = np.split(np.argsort(same.ravel(), kind="stable"), np.cumsum(np.bincount(same.ravel()))[:-1])
    lists = [x[: top + 1] for x in lists]  # equal vectors tie: more of the smallest ids can't be among the best
    one = v[first].astype(np.float64)
    length = np.sqrt((one * one).sum(1))
    unit = (one / length[:, None]).astype(np.float32)
    plain = model.encode(unit)
    codes, (along, across) = model.pack(plain), model.errors(unit, plain)
    qn = (q / np.sqrt((q * q).sum(1, keepdims=True))).astype(np.float32)
    keep = min(len(one), max(LEAST, int(np.ceil(share * len(one)))))
    out = []
    for at in range(0, len(q), 64):
        t = model.tables(qn[at : at + 64])
        score = np.zeros((len(t), len(one)), dtype=np.float32)
        for p in range(codes.shape[1]):
            score += t[:, p, :][:, codes[:, p]]
        best = np.argpartition(-score, keep - 1, axis=1)[:, :keep]
        for i in range(len(t)):
            long, own = np.sqrt((q[at + i] ** 2).sum()), int((vid == qid[at + i]).sum())
            some = best[i]
            exact = (one[some] @ q[at + i]) / (length[some] * long)
            last = lambda: np.sort(exact)[-(top + own)] if len(exact) >= top + own else -1.0  # noqa: B023, E731
            if finish and keep < len(one):
                more = could_reach(score[i], last(), along, across)
                more[some] = False
                rest = np.flatnonzero(more)
                some = np.append(some, rest)
                exact = np.append(exact, (one[rest] @ q[at + i]) / (length[rest] * long))
            floor = last()
            some, exact = some[exact >= floor], exact[exact >= floor]
            found = [(-e, int(vid[r])) for u, e in zip(some, exact, strict=True) for r in lists[u]]
            found = sorted(x for x in found if x[1] != qid[at + i])[:top]
            out += [(int(qid[at + i]), vec, -e) for e, vec in found]
    return out


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", top: int = 5, sample: int = SAMPLE, cell: int = CELL, block: int = BLOCK, query_block: int = QUERIES, share: float = SHARE, finish: bool = True) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the ``top`` largest cosines found among all vectors
    but its own id, ties to the smaller id.

    Vectors that are null, empty, zero or hold null or non-finite components take no part on either
    side, nor do those whose length isn't the most frequent one. Rows without an id take no part. A
    vector that stands under several ids counts under each. Rows with an id that stands before with
    the same vector count once. Other columns play no part. No rows: no rows.

    All centres are fitted on at most ``sample`` rows; every row is dealt to a cell, encoded and
    scanned. The result is exact within the cells that a query visits, unless ``finish`` is false.
    """
    spark = vectors.sparkSession
    arrow_rows(spark, 10_000)
    good = lambda d, i: d.select(F.col(i).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where("vec_id is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x <> 0)")
    own, asked = good(vectors, id_col), good(queries, id_col)
    sizes = own.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, count = sizes["dim"], sizes["count"]
    own, asked = own.where(F.size("v") == dim), asked.where(F.size("v") == dim)
    fit = np.stack(own.orderBy(F.xxhash64("vec_id", "v")).limit(sample).toPandas()["v"].to_numpy())
    unit = (fit / np.sqrt((fit * fit).sum(1, keepdims=True))).astype(np.float32)
    model, cells = Quantiser(unit), Cells(unit, -(-count // cell), top)
    probes = cells.probes

    def place(most: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    x = np.stack(pdf["v"].to_numpy())
                    at = cells.ranked((x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32), most)
                    yield pd.DataFrame({"vec_id": np.repeat(pdf["vec_id"].to_numpy(), most), "v": np.repeat(pdf["v"].to_numpy(), most), "cell": at.ravel()})

        return run

    schema = "vec_id long, v array<double>, cell int"
    dealt, sent = materialize(own.mapInPandas(place(1), schema), "ann-cells"), asked.mapInPandas(place(probes), schema)
    # A row a cell, at most sample / 4.
    n = dealt.groupBy("cell").count().select("cell", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    m = sent.groupBy("cell").count().select("cell", F.ceil(F.col("count") / query_block).cast("int").alias("qblocks"))
    both = materialize(n.join(m, "cell"), "ann-blocks")
    bits = F.xxhash64("vec_id")
    pick, each = (lambda c: F.pmod(bits, F.col(c)).cast("int")), (lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1)))
    left = sent.join(F.broadcast(both), "cell").withColumn("b", each("blocks")).select("cell", "b", pick("qblocks").alias("qb"), "vec_id", "v")
    right = dealt.join(F.broadcast(both), "cell").withColumn("qb", each("qblocks")).select("cell", pick("blocks").alias("b"), "qb", "vec_id", "v")

    def scan(key: tuple, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple[int, int, float]] = []
        if len(q) and len(c):
            a, b = np.stack(q["v"].to_numpy()).astype(np.float64), np.ascontiguousarray(np.stack(c["v"].to_numpy()), dtype=np.float64)
            rows = search_block(model, q["vec_id"].to_numpy(), a, c["vec_id"].to_numpy(), b + 0.0, top, share, finish)
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    keys = ["cell", "b", "qb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(scan, "query_id long, vec_id long, score double").distinct()
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op8_ann(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(rows, rows.where("vec_id % 50 = 0"))


def brute(ids: np.ndarray, v: np.ndarray, asked: Iterator[int], top: int = 5) -> list[tuple[int, int, int]]:
    """(query, rank, vec_id) by scoring all, for tests."""
    out = []
    for i in asked:
        s = exact_scores(v[i], v)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:top]
        out += [(int(ids[i]), r + 1, int(ids[j])) for r, j in enumerate(order)]
    return out
