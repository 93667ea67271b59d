"""Repeated byte windows by a depth-limited radix sort of suffixes (operator 6).

Two suffixes stay together through ``width`` bytes exactly if their first ``width`` bytes, the
window, are the same, so the sort is limited to that depth: most-significant-digit passes over the
windows' leading bytes, eight at a time. A group that can't hold windows of two documents goes no
further, and after the last digit the equal groups are exactly the repeated windows.

The sort runs in buckets. A window's bucket is a digit too, made of its least ``SEED``-byte string in an
order of hashes: equal windows have it in common, and so do most neighbours, which travel as one
string of bytes, a run. So the first pass is by this digit, and only digits travel: documents are dealt
into groups, a group sends each of its digits once, and learns which ones other groups have too. Runs
of other digits can't hold windows of two groups. Of the rest a group sends a run that several of its
documents hold once, for the first; in the others all of its windows are repeated. Strings that many
documents hold come last in the order, so that a common phrase within different contexts is cut by
the contexts, and only runs that are repeated whole, one for each group, meet in its bucket. Digits
only deal out and drop; bytes decide what is equal.

The texts are exchanged once and read three times. A task holds one group or one bucket. What groups and
buckets tell each other is never more rows than there are digits, runs or spans, however many of both there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import arrow_rows

WIDTH, SEED = 50, 24
#: Bytes of text to a group of documents, to a bucket of digits and to a bucket of runs, on average.
GROUP_BYTES, DIGIT_BYTES, BUCKET_BYTES = 3 << 20, 32 << 20, 4 << 20
#: Bytes of text that frequent strings are looked for in, of batches of 1 MB each; how often a batch must
#: hold one. This orders the strings only; results don't depend on it.
SAMPLE_BYTES, SAMPLE_BATCH, OFTEN, SLOTS = 8 << 20, 1 << 20, 4, 22
#: Windows that are hashed at once: their arrays stay in a core's cache.
BLOCK = 1 << 15

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = int(_rng.integers(0, 1 << 61)) * 8 + 5
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS.clear()
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            out = np.full(n, base, dtype=np.uint64)
            out[0] = 1
            _POWERS.append(np.multiply.accumulate(out))
    return _POWERS[0][:n], _POWERS[1][:n]


def seed_hashes(data: np.ndarray, seed: int) -> np.ndarray:
    """A hash of the ``seed`` bytes from each place on."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    x = (sums[seed:] - sums[:-seed]) * down[: len(data) - seed + 1]
    x = (x ^ (x >> _U(31))) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def runs(data: np.ndarray, ends: np.ndarray, width: int, seed: int, common: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, digit): the runs of windows with the same least string, in bytes of a buffer of
    texts. ends: for each byte, where its text ends. common: a flag for each slot of frequent strings."""
    none = np.zeros(0, dtype=np.int64)
    if len(data) < width:
        return none, none, none.astype(np.uint64)
    count = len(data) - width + 1
    least = np.empty(count, dtype=np.uint64)
    for lo in range(0, count, BLOCK):  # a hash depends on its bytes alone, so blocks give the same ones
        x = seed_hashes(data[lo : lo + BLOCK + width - 1], seed) >> _U(1)
        if common is not None:
            x |= common[x >> _U(63 - SLOTS)].astype(np.uint64) << _U(63)
        have, want = 1, width - seed + 1
        while have < want:
            step = min(have, want - have)
            x = np.minimum(x[:-step], x[step:])
            have += step
        least[lo : lo + BLOCK] = x
    new = np.ones(count, dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | (ends[1:count] != ends[: count - 1])
    at = np.flatnonzero(new)
    last = np.minimum(np.append(at[1:], count) - 1, ends[at] - width)
    keep = last >= at
    return at[keep], last[keep] + width, least[at[keep]]


def batches(ids: np.ndarray, keys: np.ndarray, texts: list[bytes], width: int, most: int = GROUP_BYTES) -> Iterator[tuple]:
    """(id, key, offset of each text's bytes in its document, bytes): texts in the order of ids, in
    batches of about ``most`` bytes; a longer text comes in overlapping pieces."""
    held: list[tuple] = []
    size = 0
    for i in np.argsort(ids, kind="stable"):
        t = texts[i]
        for at in range(0, max(1, len(t) - width + 1), most):
            part = t[at : at + most + width - 1]
            if len(part) < width:
                continue
            if held and size + len(part) > most:
                yield tuple(zip(*held, strict=True))
                held, size = [], 0
            held.append((int(ids[i]), int(keys[i]), at, part))
            size += len(part)
    if held:
        yield tuple(zip(*held, strict=True))


def short(digit: np.ndarray) -> np.ndarray:
    """40 bits of a digit, as it travels alone."""
    return digit * _U(0xD6E8FEB86659FD93) >> _U(24)


def pack_numbers(x: np.ndarray) -> bytes:
    """Ascending numbers below 2^40: their steps, byte by byte, compressed."""
    raw = np.ascontiguousarray(np.diff(x, prepend=_U(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].T).tobytes()
    return len(x).to_bytes(8, "little") + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def unpack_numbers(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    out = np.zeros((n, 8), dtype=np.uint8)
    if n:
        out[:, :5] = np.frombuffer(pa.decompress(blob[8:], 5 * n, "zstd", asbytes=True), dtype=np.uint8).reshape(5, n).T
    return np.cumsum(out.view("<u8").ravel().astype(np.uint64), dtype=np.uint64)


class Runs:
    """Packed runs: bytes one after the other, or from ``begin`` on; of each run its length, digit, document and place in it."""

    def __init__(self, data: np.ndarray, size: np.ndarray, digit: np.ndarray, doc: np.ndarray, place: np.ndarray, ids: np.ndarray, keys: np.ndarray, begin: np.ndarray | None = None):
        self.data, self.size, self.digit, self.doc, self.place, self.ids, self.keys = data, size, digit, doc, place, ids, keys
        self.begin = np.cumsum(size) - size if begin is None else begin

    def pack(self) -> bytes:
        parts = [np.array([len(self.size), len(self.ids), len(self.data)], dtype=np.int64), self.size.astype(np.int32), self.digit, self.doc.astype(np.int32), self.place.astype(np.int32), self.ids, self.keys, self.data]
        raw = b"".join(p.tobytes() for p in parts)
        return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)

    @staticmethod
    def unpack(blob: bytes) -> Runs:
        raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)
        n, docs, size = (int(x) for x in np.frombuffer(raw, dtype=np.int64, count=3))
        out, at = [], 24
        for kind, count in ((np.int32, n), (np.uint64, n), (np.int32, n), (np.int32, n), (np.int64, docs), (np.int64, docs), (np.uint8, size)):
            out.append(np.frombuffer(raw, dtype=kind, count=count, offset=at))
            at += out[-1].nbytes
        lens, digit, doc, place, ids, keys, data = out
        return Runs(data, lens.astype(np.int64), digit, doc, place, ids, keys)

    def of(self, some: np.ndarray) -> Runs:
        """Some of the runs."""
        size = self.size[some]
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - self.begin[some], size)
        docs, doc = np.unique(self.doc[some], return_inverse=True)
        return Runs(self.data[at], size, self.digit[some], doc, self.place[some], self.ids[docs], self.keys[docs])

    @staticmethod
    def joined(parts: list[Runs]) -> Runs:
        shift = np.cumsum([0, *(len(p.ids) for p in parts)])
        cat = lambda name: np.concatenate([getattr(p, name) for p in parts])
        doc = np.concatenate([p.doc.astype(np.int64) + s for p, s in zip(parts, shift, strict=False)])
        return Runs(cat("data"), cat("size"), cat("digit"), doc, cat("place"), cat("ids"), cat("keys"))

    def dealt(self, buckets: int, some: np.ndarray | None = None) -> Iterator[tuple[int, Runs]]:
        """(bucket, its runs), of all or some of the runs."""
        some = np.arange(len(self.size)) if some is None else some
        to = short(self.digit[some]) % _U(buckets)
        order = np.argsort(to, kind="stable")
        to, order = to[order].astype(np.int64), some[order]
        cut = np.flatnonzero(np.diff(to, prepend=-1))
        for lo, hi in zip(cut, np.append(cut[1:], len(to)), strict=False):
            mine = order[lo:hi]
            yield int(to[lo]), self.of(mine[np.argsort(self.digit[mine], kind="stable")])


def _spans(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of byte ranges, as maximal ranges of each document."""
    if not len(doc):
        return doc, start, stop
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order].astype(np.int64), stop[order].astype(np.int64)
    reach = stop + doc * (int(stop.max()) + 1)  # documents apart, so that one running maximum serves all
    base = start + doc * (int(stop.max()) + 1)
    top = np.maximum.accumulate(reach)
    new = np.append(True, base[1:] > top[:-1])
    first = np.flatnonzero(new)
    return doc[first], start[first], np.maximum.reduceat(stop, first)


def batch_runs(texts: list[bytes], width: int, seed: int, common: np.ndarray | None) -> tuple:
    """(bytes, where each text ends, and its runs' start, stop and digit) of a batch."""
    lens = np.array([len(t) for t in texts], dtype=np.int64)
    raw = b"".join(texts)
    stops = np.cumsum(lens)
    return raw, stops, *runs(np.frombuffer(raw, dtype=np.uint8), np.repeat(stops, lens), width, seed, common)


def of_several(digit: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The places of the digits that several documents have."""
    if not len(digit):
        return np.zeros(0, dtype=np.int64)
    order = np.argsort(digit)
    new = np.append(True, digit[order][1:] != digit[order][:-1])
    return order[_of_several(order, new, doc)]


def send(ids, keys, offsets, texts: list[bytes], width: int, seed: int, common: np.ndarray | None) -> tuple[Runs, tuple]:
    """The runs that a batch sends, and the spans (index, start, stop) that it knows to be repeated."""
    raw, stops, start, stop, digit = batch_runs(texts, width, seed, common)
    lens = np.diff(stops, prepend=0)
    of = np.searchsorted(stops, start, side="right")
    own = np.asarray(ids, dtype=np.int64)
    first: dict[bytes, int] = {}
    sent = np.ones(len(start), dtype=bool)
    some = np.sort(of_several(digit, own[of]))  # equal runs have the same digit
    for k, a, b, d in zip(some.tolist(), start[some].tolist(), stop[some].tolist(), own[of[some]].tolist(), strict=True):
        if first.setdefault(raw[a:b], d) != d:  # documents come in the order of ids
            sent[k] = False
    base = (stops - lens)[of] - np.asarray(offsets, dtype=np.int64)[of]
    known = (of[~sent], (start - base)[~sent], (stop - base)[~sent])
    s = start[sent]
    return Runs(np.frombuffer(raw, dtype=np.uint8), stop[sent] - s, digit[sent], of[sent], s - base[sent], own, np.asarray(keys, dtype=np.int64), s), known


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): an order in which equal rows of the keys are together, and where each group begins."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, new


def _of_several(order: np.ndarray, new: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The places in the order whose group holds several documents."""
    top = np.flatnonzero(new)
    d = doc[order]
    many = np.minimum.reduceat(d, top) < np.maximum.reduceat(d, top)
    return np.repeat(many, np.diff(np.append(top, len(order))))


def resolve(r: Runs, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, stop): the bytes of the bucket's runs that are covered by windows which also start
    in a document with a smaller id."""
    none = np.zeros(0, dtype=np.int64)
    ids = r.ids[r.doc]
    if not len(ids):
        return none, none, none
    order, new = _groups(r.digit)
    several = _of_several(order, new, ids)
    mine, group = order[several], np.cumsum(new)[several]
    if not len(mine):
        return none, none, none
    begin = np.cumsum(r.size) - r.size
    raw, number = r.data.tobytes(), {}
    same = np.array([number.setdefault(raw[a : a + n], len(number)) for a, n in zip(begin[mine].tolist(), r.size[mine].tolist(), strict=True)])
    least = np.full(len(number), np.iinfo(np.int64).max)
    np.minimum.at(least, same, ids[mine])
    later = ids[mine] > least[same]
    # One of each distinct run of a group that holds several stands for it in the sort.
    one = np.unique(same, return_index=True)[1]
    kinds = np.bincount(group[one], minlength=int(group.max()) + 1)
    one = one[kinds[group[one]] > 1]
    runs_, size = mine[one], r.size[mine[one]] - width + 1
    of = np.repeat(np.arange(len(one)), size)
    at = np.arange(len(of)) - np.repeat(np.cumsum(size) - size - begin[runs_], size)
    doc, place = least[same[one]][of], np.arange(len(of))
    eight = np.lib.stride_tricks.sliding_window_view(np.append(r.data, np.zeros(8, dtype=np.uint8)), 8)
    now = group[one][of]
    steps = [*range(0, width - 7, 8), *([width - 8] if width % 8 and width > 8 else [])]
    for step in steps if width >= 8 else []:
        if not len(place):
            break
        digit = np.ascontiguousarray(eight[at[place] + step]).view(">u8").ravel()
        order, new = _groups(now, digit)
        several = _of_several(order, new, doc[place])
        now, place = np.cumsum(new)[several], place[order[several]]
    hit = np.zeros(len(of), dtype=bool)
    if len(place):
        top = np.flatnonzero(np.diff(now, prepend=-1))
        low = np.minimum.reduceat(doc[place], top)
        hit[place] = doc[place] > np.repeat(low, np.diff(np.append(top, len(place))))
    # A run's hits go to all runs like it of the document that has it first.
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    # Stretches end with their run.
    a = np.flatnonzero(hit & np.append(True, ~hit[:-1] | (of[1:] != of[:-1]))) if len(hit) else none
    b = np.flatnonzero(hit & np.append(~hit[1:] | (of[1:] != of[:-1]), True)) if len(hit) else none
    del edge
    base = begin[runs_][of[a]] if len(a) else none
    lists = pd.DataFrame({"same": same[one][of[a]] if len(a) else none, "lo": at[a] - base if len(a) else none, "hi": at[b] - base + width if len(a) else none})
    firsts = pd.DataFrame({"same": same[~later], "run": mine[~later]})
    met = firsts.merge(lists, on="same")
    gone = mine[later]
    doc = np.concatenate([r.doc[gone], r.doc[met["run"].to_numpy()]])
    start = np.concatenate([r.place[gone], r.place[met["run"].to_numpy()] + met["lo"].to_numpy()])
    stop = np.concatenate([r.place[gone] + r.size[gone], r.place[met["run"].to_numpy()] + met["hi"].to_numpy()])
    return _spans(doc, start, stop)


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of the numbers are among the ascending ones."""
    at = np.searchsorted(known, x)
    return known[np.minimum(at, len(known) - 1)] == x if len(known) else np.zeros(len(x), dtype=bool)


def _rows(ids: np.ndarray, keys: np.ndarray, spans: tuple) -> pd.DataFrame:
    """(doc_id, key, spans) rows of spans by document, packed as pairs of numbers."""
    doc, start, stop = spans
    cut = np.flatnonzero(np.diff(doc, prepend=-1))
    pairs = np.column_stack([start, stop]).astype(np.int64)
    return pd.DataFrame({"doc_id": np.asarray(ids)[doc[cut]], "key": np.asarray(keys)[doc[cut]], "spans": [p.tobytes() for p in np.split(pairs, cut[1:])] if len(cut) else []})


def common_strings(docs: DataFrame, n_bytes: int, seed: int) -> np.ndarray | None:
    """A flag for each slot of strings that a sampled batch holds ``OFTEN`` times; None: no such.

    At most SAMPLE_BYTES / OFTEN numbers come to the driver."""
    share = max(1, n_bytes // SAMPLE_BYTES)

    def count(batches_: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for pdf in batches_:
            for t in pdf["text"]:
                data = (t or "").encode("utf-8", "surrogatepass")
                for at in range(0, len(data), SAMPLE_BATCH):
                    held.append(data[at : at + SAMPLE_BATCH])
                    size += len(held[-1])
                    if size >= SAMPLE_BATCH:
                        yield found(held)
                        held, size = [], 0
        if size:
            yield found(held)

    def found(held: list[bytes]) -> pd.DataFrame:
        data = np.frombuffer(b"".join(held), dtype=np.uint8)
        if len(data) < seed:
            return pd.DataFrame({"slot": np.zeros(0, dtype=np.int64)})
        slot, n = np.unique(seed_hashes(data, seed) >> _U(64 - SLOTS), return_counts=True)
        return pd.DataFrame({"slot": slot[n >= OFTEN].astype(np.int64)})

    some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(share)) == 0).select("text").coalesce(8)
    slots = [r["slot"] for r in some.mapInPandas(count, "slot long").distinct().toLocalIterator()]
    if not slots:
        return None
    out = np.zeros(1 << SLOTS, dtype=np.uint8)
    out[slots] = 1
    return out


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, seed: int = SEED, group_bytes: int = GROUP_BYTES, digit_bytes: int = DIGIT_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): for each row the maximal byte runs that are covered by
    ``width``-byte strings which also start in a document with a smaller id, and the other bytes.

    Null texts count as empty; texts shorter than ``width`` lose nothing; very long ones are read in
    pieces. Rows with the same id are no smaller than each other, so they don't remove each other's
    bytes; repeated rows stay. Rows with a null id come neither before nor after any other: they keep
    all. Other columns play no part. No rows give no rows. ``width`` is 8 or more, ``seed`` at most that.
    """
    spark = docs.sparkSession
    arrow_rows(spark, 2000)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = docs.where("doc_id is not null").withColumn("key", F.xxhash64("text"))
    n_bytes = int(docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0)
    groups, digit_buckets, buckets = (max(1, -(-n_bytes // b)) for b in (group_bytes, digit_bytes, bucket_bytes))
    shared = spark.sparkContext.broadcast(common_strings(known, n_bytes, seed))
    grp = F.pmod(F.xxhash64("doc_id", "key"), F.lit(groups)).alias("grp")

    def batched(pdf: pd.DataFrame) -> Iterator[tuple]:
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in pdf["text"]]
        return batches(pdf["doc_id"].to_numpy(np.int64), pdf["key"].to_numpy(np.int64), texts, width, 2 * group_bytes)

    def sent(pdf: pd.DataFrame) -> Iterator[tuple[Runs, tuple]]:
        for ids, keys, offsets, parts in batched(pdf):
            r, repeated = send(ids, keys, offsets, list(parts), width, seed, shared.value)
            yield r, (ids, keys, _spans(*repeated))

    def digits(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        # What a batch doesn't send has the digit of a run that it sends.
        found = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *(short(batch_runs(list(parts), width, seed, shared.value)[-1]) for *_, parts in batched(pdf))]))
        to = (found * _U(digit_buckets) >> _U(40)).astype(np.int64)
        cut = np.flatnonzero(np.diff(to, prepend=-1))
        return pd.DataFrame({"to": to[cut], "grp": key[0], "blob": [pack_numbers(x) for x in np.split(found, cut[1:])] if len(cut) else []})

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack_numbers(b) for b in pdf["blob"]]
        number, of = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        order = np.argsort(number, kind="stable")
        x = number[order]
        same = x[1:] == x[:-1]
        mine = order[np.append(same, False) | np.append(False, same)]
        who, what = of[mine], number[mine]
        order = np.lexsort((what, who))
        cut = np.flatnonzero(np.diff(who[order], prepend=-1))
        return pd.DataFrame({"grp": pdf["grp"].to_numpy()[who[order][cut]], "blob": [pack_numbers(p) for p in np.split(what[order], cut[1:])] if len(cut) else []})

    def deal(key: tuple, pdf: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
        elsewhere = np.sort(np.concatenate([np.zeros(0, dtype=np.uint64), *(unpack_numbers(b) for b in met["blob"])]))
        rows: list[tuple[int, int, int, bytes]] = []
        held = list(sent(pdf)) if len(pdf) else []
        # Digits that several documents of the group have; a document in pieces may count as several.
        shift = np.cumsum([0, *(len(r.ids) for r, _ in held)])
        own = np.concatenate([np.zeros(0, dtype=np.uint64), *(short(r.digit) for r, _ in held)])
        doc = np.concatenate([np.zeros(0, dtype=np.int64), *(r.doc + s for (r, _), s in zip(held, shift, strict=False))])
        wanted = np.union1d(elsewhere, own[of_several(own, doc)])
        for r, (ids, keys, repeated) in held:
            rows += [(to, 0, int(key[0]), part.pack()) for to, part in r.dealt(buckets, np.flatnonzero(_among(short(r.digit), wanted)))]
            spans = _rows(ids, keys, repeated)
            if len(spans):  # what the group knows already passes through a bucket as it is
                rows.append((int(key[0]) % buckets, 1, int(key[0]), _framed(spans)))
        return pd.DataFrame(rows, columns=["to", "kind", "grp", "blob"])

    def sort(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf.loc[pdf["kind"] == 1, ["grp", "blob"]]
        own = pdf[pdf["kind"] == 0]
        if not len(own):
            return out
        parts = [Runs.unpack(b) for b in own["blob"]]
        home = np.repeat(own["grp"].to_numpy(np.int64), [len(p.ids) for p in parts])
        r = Runs.joined(parts)
        del parts
        doc, start, stop = resolve(r, width)
        order = np.argsort(home[doc], kind="stable")
        doc, start, stop = doc[order], start[order], stop[order]
        # One value for each group that is told something.
        cut = np.flatnonzero(np.diff(home[doc], prepend=-1))
        ends = np.append(cut[1:], len(doc))
        told = [_framed(_rows(r.ids, r.keys, (doc[a:b], start[a:b], stop[a:b]))) for a, b in zip(cut, ends, strict=False)]
        return pd.concat([out, pd.DataFrame({"grp": home[doc[cut]], "blob": told})])

    dealt = known.withColumn("grp", grp).repartition("grp")
    said = dealt.groupBy("grp").applyInPandas(digits, "to long, grp long, blob binary").groupBy("to").applyInPandas(meet, "grp long, blob binary")
    moved = dealt.groupBy("grp").cogroup(said.groupBy("grp")).applyInPandas(deal, "to long, kind int, grp long, blob binary")
    found = moved.groupBy("to").applyInPandas(sort, "grp long, blob binary")
    out = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    result = dealt.groupBy("grp").cogroup(found.groupBy("grp")).applyInPandas(_cut, out)
    whole = docs.where("doc_id is null").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("spans"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("kept"))
    return result.unionAll(whole)


def _framed(spans: pd.DataFrame) -> bytes:
    """(doc_id, key, spans) rows as one value."""
    sizes = np.array([len(s) for s in spans["spans"]], dtype=np.int64)
    return np.concatenate([[len(sizes)], spans["doc_id"].to_numpy(np.int64), spans["key"].to_numpy(np.int64), sizes]).astype(np.int64).tobytes() + b"".join(spans["spans"])


def _unframed(blob: bytes) -> pd.DataFrame:
    n = int(np.frombuffer(blob, dtype=np.int64, count=1)[0])
    ids, keys, sizes = np.frombuffer(blob, dtype=np.int64, count=3 * n, offset=8).reshape(3, n)
    stops = np.cumsum(sizes) + 8 + 24 * n
    return pd.DataFrame({"doc_id": ids, "key": keys, "spans": [blob[b - s : b] for s, b in zip(sizes, stops, strict=True)]})


def _cut(key: tuple, pdf: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    """The group's rows with their spans and what is left."""
    known: dict[tuple[int, int], list[bytes]] = {}
    for blob in found["blob"]:
        for i, k, s in _unframed(blob).itertuples(index=False):
            known.setdefault((i, k), []).append(s)
    spans, kept, sizes = [], [], []
    for i, k, text in pdf[["doc_id", "key", "text"]].itertuples(index=False):
        t = (text or "").encode("utf-8", "surrogatepass")
        own: list[tuple[int, int]] = []
        if (i, k) in known:
            pairs = np.concatenate([np.frombuffer(f, dtype=np.int64).reshape(-1, 2) for f in known[i, k]])
            _, a, b = _spans(np.zeros(len(pairs), dtype=np.int64), pairs[:, 0], pairs[:, 1])
            own = list(zip(a.tolist(), b.tolist(), strict=True))
        edges = [0, *(x for s in own for x in s), len(t)]
        spans.append([{"start": a, "end": b} for a, b in own])
        kept.append(b"".join(t[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)))
        sizes.append(len(t))
    return pd.DataFrame({"doc_id": pdf["doc_id"], "n_bytes": sizes, "spans": spans, "kept": kept})


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return repeated_spans(docs).select(
        "doc_id",
        "n_bytes",
        F.coalesce(F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)"), F.lit(0)).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def brute_spans(rows: list[tuple[int, bytes]], width: int = WIDTH) -> dict[int, list[tuple[int, int]]]:
    """The definition itself, for tests with distinct ids."""
    seen: dict[bytes, int] = {}
    for i, t in rows:
        for at in range(len(t) - width + 1):
            w = t[at : at + width]
            seen[w] = min(seen.get(w, i), i)
    out = {}
    for i, t in rows:
        on = np.zeros(len(t) + 2, dtype=bool)
        for at in range(len(t) - width + 1):
            if seen[t[at : at + width]] < i:
                on[at + 1 : at + 1 + width] = True
        edge = np.flatnonzero(on[1:] != on[:-1])
        out[i] = list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
    return out


def digest(t: bytes, spans: list[tuple[int, int]]) -> str:
    edges = [0, *(x for s in spans for x in s), len(t)]
    return hashlib.sha256(b"".join(t[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))).hexdigest()
