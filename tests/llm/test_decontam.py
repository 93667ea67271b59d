"""Documents shorter than the benchmark item that they are."""

import random

import pytest

import numpy as np

from tracewell.llm import decontam

ITEM = [f"w{i}" for i in range(38)]
ITEMS = [(1, " ".join(ITEM)), (2, " ".join(ITEM[3:30])), (3, "one two three four"), (4, "a b c d e f g")]


def cut(*gone):
    return " ".join(w for i, w in enumerate(ITEM) if i not in gone)


def test_item_without_its_last_word():
    [(item, start, words, similar)] = decontam.Index(ITEMS[:1]).search(cut(37))
    assert (item, start, words) == (1, 0, 37) and similar == pytest.approx(33 / 34)
    assert not decontam.Index(ITEMS[:1]).search(cut(*range(31, 38)))


def test_short_documents_match_brute_force():
    rng = random.Random(2)
    texts = [cut(), cut(0), cut(37), cut(0, 37), cut(20), *(cut(*range(n, 38)) for n in range(28, 38)), "one two three", "a b c d e f", "a b c d", "b c d e f g"]
    texts += [cut(*rng.sample(range(38), rng.randint(1, 3))) for _ in range(60)]
    index, found = decontam.Index(ITEMS), 0
    for text in texts:
        got = {(0, i): (p, s) for i, p, _, s in index.search(text)}
        assert got == decontam.brute([(0, text)], ITEMS)
        found += (0, 1) in got
    assert found > 10


def test_short_document_is_dropped(spark):
    docs = spark.createDataFrame([(1, cut(37)), (2, cut(*range(19)))], "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    assert [tuple(r)[:4] for r in decontam.leaks(docs, bench).collect()] == [(1, 1, 0, 37)]
    assert [r["doc_id"] for r in decontam.without_leaks(docs, bench).collect()] == [2]


def test_tables_find_all_within_the_radius():
    rng = np.random.default_rng(4)
    items = [(i, " ".join(f"w{x}" for x in rng.integers(0, 3000, 30))) for i in range(400)]
    index = decontam.Index(items)
    flips = [np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, n, replace=False).astype(np.uint64)) if n else np.uint64(0) for n in rng.integers(0, 30, 300)]
    prints = index.prints[rng.integers(0, 400, 300)] ^ np.array(flips, dtype=np.uint64)
    want = {(w, i) for w in range(300) for i in range(400) if int(np.bitwise_count(prints[w] ^ index.prints[i])) <= index.radius}
    assert index.lookup(30, prints) == want


def test_recall_at_the_threshold():
    """Edited copies of items around a similarity of 0.8, against every window compared exactly."""
    rng = np.random.default_rng(6)
    items = [(i, " ".join(f"w{x}" for x in rng.integers(0, 2000, int(rng.integers(30, 70))))) for i in range(60)]
    docs = []
    for k in range(400):
        words = items[int(rng.integers(0, 60))][1].split()
        for at in rng.choice(len(words), int(rng.integers(0, 3)), replace=False):
            words[at] = f"x{k}"
        pad = [f"p{x}" for x in rng.integers(0, 500, 20)]
        docs.append((k, " ".join(pad + words + pad)))
    want = decontam.brute(docs, items)
    index = decontam.Index(items)
    got = {(d, x[0]) for d, t in docs for x in index.search(t)}
    assert len(want) > 200 and got <= set(want) and len(got) / len(want) >= 0.99
