"""Near-duplicate groups against all pairs."""

import hashlib
import random

import numpy as np
import pytest

from tracewell.llm import near_duplicates as nd

DOCS = "doc_id long, text string"


def brute(texts):
    """{text: least text of its component} by comparing all pairs."""
    sets, label = [nd.shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and nd.similarity(sets[i], sets[j]) >= nd.SIMILAR:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def edited(rng, words, edits):
    out = list(words)
    for at in rng.sample(range(5, len(words) - 5, 5), edits):
        out[at] = f"e{rng.random()}"
    return " ".join(out)


def hub(copies, seed):
    """A text and copies of it, each similar to it and to no other copy."""
    rng = random.Random(seed)
    words = [f"{seed}w{i}" for i in range(120)]
    return [" ".join(words)] + [edited(rng, words, 2) for _ in range(copies)]


def kept(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), DOCS)
    return sorted(r["doc_id"] for r in nd.drop_near_duplicates(rows).collect())


def least(texts):
    return sorted(set(brute(texts)))


@pytest.mark.parametrize("tile", [8, 256])
def test_hub_with_edited_copies(spark, monkeypatch, tile):
    monkeypatch.setattr(nd, "TILE", tile)
    texts = hub(40, 1)
    md5 = [hashlib.md5(t.encode()).hexdigest() for t in texts]
    assert md5[0] != min(md5) and least(texts) == [0]
    assert kept(spark, texts) == [0]


def test_similar_pairs_match_plain_comparison(monkeypatch):
    monkeypatch.setattr(nd, "CHUNK", 7)
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 30, n).astype(np.uint64)) for n in rng.integers(0, 60, 50)]
    want = np.array([[nd.similarity(a, b) >= 0.6 for b in sets] for a in sets])
    for side in (np.zeros(50, dtype=bool), np.arange(50) % 3 == 0):
        across = side[:, None] != side[None, :] if side.any() else True
        assert (nd.similar_pairs(sets, side, 0.6) == (want & across)).all()
    assert nd.similar_pairs([], np.zeros(0, dtype=bool), 0.6).shape == (0, 0)


def test_forest_connects():
    near = np.zeros((6, 6), dtype=bool)
    for a, b in [(0, 3), (3, 5), (0, 5), (1, 2)]:
        near[a, b] = near[b, a] = True
    assert sorted(nd.forest(near)) == [(0, 3), (0, 5), (1, 2)]


@pytest.mark.parametrize("tile", [8, 256])
def test_groups_of_the_same_members_give_the_same_links(spark, monkeypatch, tile):
    """Links of tiles are between components, however many members and groups the components share."""
    monkeypatch.setattr(nd, "TILE", tile)
    rng = random.Random(7)
    words = [f"w{i}" for i in range(120)]
    held = spark.createDataFrame([(f"t{i:02d}", edited(rng, words, 1)) for i in range(60)], "text_id string, text string")
    groups = spark.createDataFrame([(g, f"t{i:02d}", f"t{i % 6:02d}") for g in range(12) for i in range(60)], "grp long, text_id string, component string")
    links = {tuple(r) for r in nd._tiled(groups, held, 0.8).collect()}
    assert len(links) <= 15 and {x for link in links for x in link} == {f"t{i:02d}" for i in range(6)}
    found = nd.connected_components(spark.createDataFrame(sorted(links), "src string, dst string")).collect()
    assert {r["component"] for r in found} == {"t00"}


def test_stage_matches_all_pairs(spark):
    """Hubs, chains and texts that share a passage only, through the pipeline's stage."""
    import corpus_pipeline

    rng = random.Random(4)
    texts = hub(15, 5)
    words = [f"c{i}" for i in range(120)]
    for step in range(12):
        words = list(words)
        words[5 + 9 * step] = f"x{step}"
        texts.append(" ".join(words))
    passage = " ".join(f"p{i}" for i in range(70))
    for k in range(25):
        own = " ".join(f"o{k}-{i}" for i in range(50))
        texts += [f"{passage} {own}"] + ([f"{passage} {own} end"] if k % 3 == 0 else [])
    rng.shuffle(texts)
    rows = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, rows, "").collect())
    assert len(least(texts)) == 27 and got == least(texts)


def test_clashing_columns_stay(spark):
    rows = [(1, "a b c d e f", 1, 2, 0.5, "x"), (2, "a b c d e f", 3, 4, 0.6, "y"), (3, "other words are here now", 5, 6, 0.7, None), (None, None, 7, 8, None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, text_number int, __row int, __text double, ROW_NAME string")
    got = nd.drop_near_duplicates(df)
    assert got.columns == df.columns and sorted((tuple(r) for r in got.collect()), key=repr) == sorted((rows[i] for i in (0, 2, 3)), key=repr)


def test_quality_stage_keeps_a_score(spark, sf):
    import corpus_pipeline
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("score", F.lit("mine")).withColumn("__score", F.lit(1))
    got = corpus_pipeline.quality(spark, docs, sf)
    assert got.columns == docs.columns and 0 < got.count() < docs.count() and got.where("score <> 'mine' or __score <> 1").count() == 0


def test_planted_pairs_are_found(spark):
    """Pairs at a similarity of 0.80 to 0.86 by design: at most one in a hundred may be missed."""
    rng = random.Random(11)
    texts = []
    for k in range(200):
        words = [f"w{k}-{rng.randrange(10**6)}" for _ in range(154)]
        other = list(words)
        for at in (30, 90, 140)[: 2 + k % 2]:
            other[at] = f"x{k}-{at}"
        texts += [" ".join(words), " ".join(other)]
    near = [nd.similarity(nd.shingles(a), nd.shingles(b)) for a, b in zip(texts[::2], texts[1::2], strict=True)]
    assert all(0.8 <= s <= 0.9 for s in near)
    rows = spark.createDataFrame(list(enumerate(texts)), DOCS)
    kept = {r["doc_id"] for r in nd.drop_near_duplicates(rows).collect()}
    assert {i for i in range(0, 400, 2)} <= kept and len(kept & set(range(1, 400, 2))) <= 2
