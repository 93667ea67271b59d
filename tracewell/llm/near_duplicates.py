"""One document of each group of near-duplicates, by SimHash fingerprints and exact shingles.

Texts are compared by the sets of their five-word shingles. Beside the SimHash of all shingles, whose
links come from the anchor-point covering, a text has a SimHash of the five least shingles under each
of a row of hash orders: covering the SimHash of all shingles alone would need a threshold of some
sixteen bits for a similarity of 0.8. Texts of similarity 0.8 have each of these alike with a chance
of about a third, so that one pair in some three thousand has none of twenty alike.

Texts with a fingerprint alike make a candidate group; groups of the same members count once. In
each round a text is compared, exactly, with one other text: the least head of those of its groups
that aren't connected yet, in an order of that round. So a round makes at most one pair a text, and a group of copies is
connected after the first. Groups that stay in parts are dealt into tiles: first of fingerprints, which
leave only members that are within ``RADIUS`` bits of another part's member, then of texts, whose
pairs are all compared, exactly, but for those of the group's largest part with itself. So every pair
of a group is linked, connected, verified apart or has fingerprints too far apart at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import arrow_rows, connected_components, forget, free_name, hand_over, materialize
from tracewell.llm.simhash_dedup import links

WORDS, SIMILAR, ORDERS, LEAST = 5, 0.8, 20, 5
#: Texts and fingerprints to a tile, and shingles that are counted at once.
TILE, PRINTS, CHUNK = 256, 2048, 4096
#: Rounds of single comparisons before the tiles.
ROUNDS = 3
#: Bits that the fingerprints of all shingles of texts at 0.8 differ in: 9.7 on average, over 24 once in some million pairs.
RADIUS = 24
_ODD = (np.arange(1, ORDERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Hashes of all runs of ``words`` words; of fewer words, of all together; of none, none."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, dtype=np.uint64)
    grams = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    return np.array([xxhash.xxh64_intdigest(g, 7) for g in grams], dtype=np.uint64)


def _print(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def sketch(text: str | None) -> tuple[int, list[int]]:
    """The SimHash of the set of shingles, and those of the least shingles under each hash order."""
    one = np.unique(shingles(text))
    subs = []
    for odd in _ODD:
        x = one * odd
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        subs.append(_print(one[np.argpartition(x, LEAST - 1)[:LEAST]] if len(one) > LEAST else one))
    return _print(one), subs


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def _text_id(text: Column) -> Column:
    plain = F.coalesce(text.cast("string"), F.lit(""))
    return F.md5(F.when(F.length(F.trim(F.translate(plain, "\t\n\x0b\x0c\r", "     "))) == 0, F.lit("")).otherwise(plain).cast("binary"))


def classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(text_id, component) for the distinct texts that are similar to another; text_id is the MD5 of the text."""
    spark = docs.sparkSession
    arrow_rows(spark, 2000)
    texts = docs.select(_text_id(F.col("text")).alias("text_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.drop_duplicates("text_id")
            got = [sketch(t) for t in pdf["text"]]
            yield pd.DataFrame({"text_id": pdf["text_id"].to_numpy(), "fp": [g[0] for g in got], "subs": [g[1] for g in got]})

    sketched = materialize(texts.mapInPandas(run, "text_id string, fp long, subs array<long>").dropDuplicates(["text_id"]), "sketches")
    groups = _groups(sketched)
    if groups.isEmpty():
        forget(sketched, groups)
        return spark.createDataFrame([], "text_id string, component string")
    # Copies are dropped before the exchange: a text that a third of all rows have is no hot key.
    held = materialize(texts.dropDuplicates(["text_id"]).join(groups.select("text_id").distinct(), "text_id", "left_semi"), "candidate-texts")
    prints = materialize(groups.select("text_id").distinct().join(sketched.select("text_id", "fp"), "text_id"), "candidate-prints")
    forget(sketched)
    links, labels = None, held.select("text_id", F.col("text_id").alias("component"))
    for k in range(ROUNDS):
        groups, parted = _parted(groups, labels), groups
        forget(parted)
        if groups.isEmpty():
            break
        links, old = _with(links, _judged(_asked(groups, k), held, similar)), links
        forget(old)
        labels, old = _labels(links, held), labels
        forget(old)
    open_, last = _parted(groups, labels), groups
    near = materialize(_near(open_, prints), "near-members")
    forget(last, open_, prints, links)
    ties = materialize(_tiled(near, held, similar).distinct(), "tile-links")
    forget(near)
    merged = connected_components(ties, "text-components")
    forget(ties)
    out = materialize(_merged(labels, merged), "text-classes")
    forget(labels, merged, held)
    return out


def _groups(sketched: DataFrame) -> DataFrame:
    """(grp, text_id): the texts that share a fingerprint with another, or a link of two; of groups of the same texts one."""
    heads = materialize(sketched.groupBy("fp").agg(F.min("text_id").alias("head")), "heads")
    a, b = (heads.select(F.col("fp").alias(c), F.col("head").alias(f"{c}_id")) for c in ("src", "dst"))
    ends = materialize(links(heads.select("fp")).join(a, "src").join(b, "dst").select(F.least("src_id", "dst_id").alias("a"), F.greatest("src_id", "dst_id").alias("b")), "near-prints")
    near = ends.select(F.xxhash64(F.lit(-2), "a", "b").alias("grp"), F.explode(F.array("a", "b")).alias("text_id"))
    prints = sketched.select("text_id", F.posexplode(F.concat("subs", F.array("fp"))).alias("k", "s"))
    prints = prints.select(F.xxhash64("k", "s").alias("grp"), "text_id").unionAll(near)
    # Two numbers that depend on the members alone tell groups of the same members; a hash of a name that
    # two groups share only makes one group of two, whose pairs are all verified.
    bits = F.xxhash64("text_id")
    many = prints.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.min("text_id").alias("low"), F.max("text_id").alias("high"), F.sum(bits.cast("decimal(38,0)")).alias("s"), F.bit_xor(bits).alias("x"))
    one = many.where("low <> high").groupBy("n", "low", "high", "s", "x").agg(F.min("grp").alias("grp")).select("grp")
    out = materialize(prints.join(one, "grp").distinct(), "groups")
    forget(heads, ends)
    return out


def _parted(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """(grp, text_id, component) of the groups whose members are of several components."""
    own = groups.select("grp", "text_id").join(labels, "text_id", "left").select("grp", "text_id", F.coalesce("component", "text_id").alias("component"))
    own = materialize(own, "group-members")
    open_ = own.groupBy("grp").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("grp")
    out = materialize(own.join(open_, "grp"), "parted-groups")
    forget(own)
    return out


def _asked(groups: DataFrame, k: int) -> DataFrame:
    """(text_id, head): for each text the least of its groups' heads, of those of another component.

    Heads are the least members in an order of round ``k``'s own, so that groups with many members
    in common have the same head more often than not, and another one in each round.
    """
    order = F.xxhash64(F.lit(k), "text_id")
    heads = groups.groupBy("grp").agg(F.min(F.struct(order.alias("o"), "text_id", "component")).alias("h"))
    met = groups.join(heads, "grp").where("component <> h.component")
    return met.groupBy("text_id").agg(F.min("h").alias("h")).select("text_id", F.col("h.text_id").alias("head"))


def _judged(pairs: DataFrame, held: DataFrame, similar: float) -> DataFrame:
    """(src, dst): the pairs whose texts are similar."""

    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            last, sets, out = None, None, []
            for s, t in zip(x, y, strict=True):
                if t != last:
                    last, sets = t, shingles(t)
                out.append(similarity(shingles(s), sets) >= similar)
            yield pd.Series(out, dtype=bool)

    alike = F.pandas_udf(judge, "boolean")
    head = held.select(F.col("text_id").alias("head"), F.col("text").alias("head_text"))
    judged = pairs.join(held, "text_id").join(head, "head").select("text_id", "head", alike("text", "head_text").alias("ok"))
    return materialize(judged.where("ok").select(F.col("head").alias("src"), F.col("text_id").alias("dst")), "judged")


def _with(links: DataFrame | None, more: DataFrame) -> DataFrame:
    if links is None:
        return more
    out = materialize(links.unionAll(more).distinct(), "near-links")
    forget(more)
    return out


def _labels(links: DataFrame, held: DataFrame) -> DataFrame:
    found = connected_components(links, "part-components")
    return hand_over(found, found.select(F.col("node").alias("text_id"), "component"))


def _merged(labels: DataFrame, merged: DataFrame) -> DataFrame:
    """(text_id, component): the texts' components after those that the tiles found alike are one; a component that
    is no text's yet is a text of its own."""
    to = merged.select(F.col("node").alias("component"), F.col("component").alias("least"))
    moved = labels.join(to, "component", "left").select("text_id", F.coalesce("least", "component").alias("component"))
    alone = merged.select(F.col("node").alias("text_id"), "component").join(labels, "text_id", "left_anti")
    return moved.unionByName(alone)


def _dealt(groups: DataFrame, size: int) -> DataFrame:
    """(tile, i, j, t, grp, text_id, component): the members of parted groups in tiles of about ``size``.

    A group's members outside its most frequent component meet all members, tile by tile; groups of
    a tile or less share tiles, where only members of the same group are of interest.
    """
    sizes = groups.groupBy("grp", "component").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.groupBy("grp").agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    sizes = materialize(sizes.select("grp", "n", F.col("most.component").alias("base"), (F.col("n") - F.col("most.n")).alias("rest")), "tile-sizes")
    some = F.coalesce(F.sum("n"), F.lit(0))
    shared = max(1, -(-(sizes.where(F.col("n") <= size).agg(some.alias("n")).first()["n"]) // size))
    met = groups.join(sizes, "grp")
    few = met.where(F.col("n") <= size).select(F.pmod(F.xxhash64("grp"), F.lit(shared)).alias("tile"), F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.lit(-1).alias("t"), "grp", "text_id", "component")
    tiles = lambda n: F.greatest(F.lit(1), F.ceil(n / size)).cast("int")
    many = met.where(F.col("n") > size).withColumn("r", tiles(F.col("rest"))).withColumn("b", tiles(F.col("n") - F.col("rest")))
    bits = F.xxhash64("text_id")
    many = many.withColumn("t", F.when(F.col("component") == F.col("base"), F.col("r") + F.pmod(bits, F.col("b"))).otherwise(F.pmod(bits, F.col("r"))).cast("int"))
    # Tile t meets each tile of the rest; one of the rest meets those of the base too.
    other = F.when(F.col("t") < F.col("r"), F.sequence(F.lit(0), F.col("r") + F.col("b") - 1)).otherwise(F.sequence(F.lit(0), F.col("r") - 1))
    many = many.withColumn("o", F.explode(other)).select(F.col("grp").alias("tile"), F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"), "t", "grp", "text_id", "component")
    return few.unionAll(many)


def _near(groups: DataFrame, prints: DataFrame) -> DataFrame:
    """(grp, text_id, component): the members that have one of another component within the radius."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept = []
        for grp, own in pdf.groupby("grp"):
            fp, part = own["fp"].to_numpy().view(np.uint64), own["component"].to_numpy()
            side = (own["t"] != own["i"]).to_numpy()
            near = np.zeros(len(own), dtype=bool)
            code = np.unique(part, return_inverse=True)[1]
            for at in range(0, len(own), 256):
                cut = slice(at, at + 256)
                close = (np.bitwise_count(fp[cut, None] ^ fp[None, :]) <= RADIUS) & (code[cut, None] != code[None, :])
                if side.any() and not side.all():
                    close &= side[cut, None] != side[None, :]
                near[cut] |= close.any(1)
            some = own["text_id"].to_numpy()[near]
            kept.append(pd.DataFrame({"grp": np.full(len(some), grp), "text_id": some, "component": part[near]}))
        return pd.concat(kept)

    dealt = _dealt(groups, PRINTS).join(prints, "text_id")
    return dealt.groupBy("tile", "i", "j").applyInPandas(run, "grp long, text_id string, component string").distinct()


def _tiled(groups: DataFrame, held: DataFrame, similar: float) -> DataFrame:
    """Links (src, dst) of components that connect all that have similar members in a group: in each tile from the
    least of those that are alike to the others, so that groups with the same members give the same links."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("text_id")
        side = (pdf["t"] != pdf["i"]).to_numpy()
        links = ties(similar_pairs([np.unique(shingles(t)) for t in pdf["text"]], side, similar), pdf["component"].to_numpy())
        return pd.DataFrame(links, columns=["src", "dst"], dtype=object)

    dealt = _dealt(groups, TILE).select("tile", "i", "j", "t", "text_id", "component").distinct()
    return dealt.join(held, "text_id").groupBy("tile", "i", "j").applyInPandas(run, "src string, dst string")


def similar_pairs(sets: list[np.ndarray], side: np.ndarray, similar: float) -> np.ndarray:
    """A matrix of which of the sets are similar: of one side all pairs, of two those across."""
    n = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    owner = np.repeat(np.arange(n), size)
    known, word, count = np.unique(np.concatenate([*sets, np.zeros(0, dtype=np.uint64)]), return_inverse=True, return_counts=True)
    number = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[word] if len(known) else word
    owner, number = owner[number >= 0], number[number >= 0]
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    left, right = (np.flatnonzero(~side), np.flatnonzero(side)) if side.any() and not side.all() else (np.arange(n), np.arange(n))
    both = np.zeros((len(left), len(right)), dtype=np.float64)
    for low in range(0, int(number[-1]) + 1 if len(number) else 0, CHUNK):
        a, b = np.searchsorted(number, [low, low + CHUNK])
        part = np.zeros((n, CHUNK), dtype=np.float32)
        part[owner[a:b], number[a:b] - low] = 1
        both += part[left] @ part[right].T
    whole = size[left][:, None] + size[right][None, :] - both
    out = np.zeros((n, n), dtype=bool)
    out[np.ix_(left, right)] = np.where(whole > 0, both / np.maximum(whole, 1), 1.0) >= similar
    return out | out.T


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of a symmetric matrix that connect what all its pairs connect."""
    seen, out = np.zeros(len(near), dtype=bool), []
    for start in range(len(near)):
        stack = [] if seen[start] else [start]
        seen[start] = True
        while stack:
            a = stack.pop()
            new = np.flatnonzero(near[a] & ~seen)
            seen[new] = True
            out += [(a, int(b)) for b in new]
            stack += new.tolist()
    return out


def ties(near: np.ndarray, parts: np.ndarray) -> list[tuple[str, str]]:
    """(least, other) names of parts that pairs of a symmetric matrix of their members connect."""
    names, code = np.unique(parts, return_inverse=True)
    met = np.zeros((len(names), len(names)), dtype=bool)
    a, b = np.nonzero(near)
    met[code[a], code[b]] = True
    root: dict[int, int] = {}
    for x, y in forest(met):  # a tree's pairs follow each other, from its least part on
        root[y] = root.get(x, x)
    return [(names[x], names[y]) for y, x in root.items()]


def drop_near_duplicates(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the row with the least doc_id stays.

    Groups are the components of texts whose five-word shingle sets have a similarity of ``similar``
    or more. Texts without words are all alike. A null id comes after all others. Of rows with the
    same id and text one stays. Other columns stay, whatever their names. No rows: no rows.
    """
    spark = docs.sparkSession
    found = classes(docs, similar)
    text, row = free_name(docs, "text_number"), free_name(docs, "row_name")
    own = docs.withColumn(text, _text_id(F.col("text")))
    order = F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id").cast("long").alias("id"), F.col(text).alias("text_id"))
    texts = own.groupBy(F.col(text).alias("own_text")).agg(F.min(order).alias("least"))
    grouped = texts.join(found, F.col("own_text") == F.col("text_id"), "left").select("least", F.coalesce("component", "own_text").alias("component"))
    kept = grouped.groupBy("component").agg(F.min("least").alias("k")).select(F.concat(F.coalesce(F.col("k.id").cast("string"), F.lit("-")), F.lit("|"), F.col("k.text_id")).alias(row))
    kept = materialize(kept, "kept")
    forget(found)
    rows = own.withColumn(row, F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("|"), text)).drop(text)
    arrow_rows(spark, 2000)
    return rows.dropDuplicates([row]).join(kept, row, "left_semi").drop(row).select(*docs.columns)
