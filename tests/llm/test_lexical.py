"""Operator 13 against scores by hand, over every document."""

import math
import random
import re
from collections import Counter

import numpy as np

from tracewell.llm import lexical

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return Counter(WORD.findall((text or "").translate(FOLD)))


def brute(docs, items, top=10):
    held = [(i, c) for i, t in docs if (c := terms(t))]
    total, asked = sum(c.total() for _, c in held), {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(terms(t))
    df, out = Counter(w for _, c in held for w in c), []
    for item, q in asked.items():
        w = {t: math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1))) for t in q}
        scores = []
        for d, c in held:
            m = 25 + 75 * c.total() * len(held) // total
            scores.append((-sum(n * w[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, n in q.items() if c[t]), d))
        out += [(item, k, d, -s) for k, (s, d) in enumerate(sorted(x for x in scores if x[0] and x[1] is not None)[:top], 1)]
    return sorted(out, key=repr)


def check(spark, docs, items, **options):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, n string, term long")
    q = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, rank int")
    got = [tuple(r) for r in lexical.rankings(df, q, **options).collect()]
    assert sorted(got, key=repr) == brute(docs, items, options.get("top", 10))
    return got


def test_odd_rows(spark):
    docs = [(1, "The cat, the CAT_42 x"), (1, "The cat, the CAT_42 x"), (2, None), (3, ""), (None, "cat cat"), (4, "Straße ÄRGER 42 cat"), (5, "dog " * 40_000 + "42"), (6, " ,.; ")]
    items = [(1, "cat cat 42"), (2, None), (3, "!!"), (None, "dog"), (4, "nowhere"), (4, "the dog")]
    got = check(spark, docs, items)
    assert {r[0] for r in got} == {1, None, 4}
    assert check(spark, [], items) == [] and check(spark, docs, []) == []


def test_ties_and_several_indexes(spark):
    draw = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(draw.choices(words, k=draw.randrange(1, 30)))) for i in range(400)] + [(1000 + i, "w1 w2 same") for i in range(50)]
    items = [(i, " ".join(draw.choices(words, k=8))) for i in range(12)] + [(50, "same")]
    check(spark, docs, items)
    check(spark, docs, items, index_words=20, top=3)


def test_blocks_and_radix(spark, monkeypatch):
    draw = np.random.default_rng(1)
    for bits in (3, 16, 17, 40):
        keys = draw.integers(0, 1 << bits, 2000, dtype=np.uint64)
        assert (lexical.radix_order(keys, bits) == np.argsort(keys, kind="stable")).all()
    item, doc, value = draw.integers(0, 7, 500), draw.integers(0, 9, 500), draw.integers(0, 100, 500)
    want = Counter()
    for i, d, v in zip(item.tolist(), doc.tolist(), value.tolist(), strict=True):
        want[i, d] += v
    got = lexical.accumulate(doc, item, value, 9, 7)
    assert list(zip(*(x.tolist() for x in got), strict=True)) == [(i, d, want[i, d]) for i, d in sorted(want)]
