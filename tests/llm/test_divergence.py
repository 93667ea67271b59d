"""Operator 11 against a dense count of every group and term."""

import random
import re
from collections import Counter

from tracewell.llm import divergence

WORD = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, min_docs=3, scale=1_000_000_000, top=200):
    """{(lang, source, part, item): (value, rank)}, priced term by term."""
    rows = [tuple(x or "" for x in r) for r in rows]
    count, docs = {}, Counter()
    for text, lang, source in rows:
        words = WORD.findall(text.translate(FOLD))
        count.setdefault((lang, source), Counter()).update(words)
        docs.update((lang, w) for w in set(words))
    out = {}
    for (lang, source), own in count.items():
        kept = [w for (l, w), n in docs.items() if l == lang and n >= min_docs]
        share = lambda c: (lambda total: {w: 1 + scale * (c[w] + 1) // (total + len(kept)) for w in kept})(sum(c[w] for w in kept))
        p, q = share(own), share(sum((c for (l, _), c in count.items() if l == lang), Counter()))
        parts = {"pair": [(s, sum((p[w] - o[w]) ** 2 // o[w] for w in kept)) for (l, s), c in count.items() if l == lang and s != source for o in [share(c)]]}
        parts["term"] = sorted(((w, (p[w] - q[w]) ** 2 // q[w]) for w in kept if own[w] and p[w] > q[w]), key=lambda x: (-x[1], x[0].encode()))[:top]
        for part, items in parts.items():
            for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode())), 1):
                out[lang, source, part, item] = (value, rank)
    return out


def check(spark, rows, **options):
    df = spark.createDataFrame([(*r, 0, 0.0) for r in rows], "text string, lang string, source string, n long, value double")
    got = divergence.divergences(df, **options).collect()
    assert len(got) == len({tuple(r[:4]) for r in got})
    assert {tuple(r[:4]): (r["value"], r["rank"]) for r in got} == brute(rows, **options)
    return got


def test_odd_rows_equal_the_dense_count(spark):
    rows = [
        ("The cat, the CAT; Straße Ärger ÄRGER 12x", "en", "a"), ("the cat sat", "en", "b"), ("the dog", "en", None), ("the dog sat_on it's", "en", "b"),
        (None, "en", "empty"), ("", None, None), ("ein wort", "de", "a"), ("dog dog dog " * 5000 + "the", "en", "long"), ("the cat sat", "en", "b"), ("cat", None, "x"), ("cat", "", "y"), ("cat \U0001f600 \U0001f600cat", "", "y"),
    ]
    got = check(spark, rows)
    assert {r["source"] for r in got if r["lang"] == "de"} == set()  # one group, no kept term: no rows
    assert {(r["source"], r["item"]) for r in got if r["lang"] == ""} == {(a, b) for a in ("", "x", "y") for b in ("", "x", "y") if a != b}
    assert check(spark, []) == []


def test_random_groups_and_ties(spark):
    draw = random.Random(5)
    words = [f"{a}{b}" for a in "abcdefgh" for b in "klmnop"]
    rows = [(" ".join(draw.choice(words) for _ in range(draw.randrange(12))), draw.choice(["en", "fr"]), draw.choice("pqrs")) for _ in range(150)]
    rows += [("same words here", "xx", s) for s in "abcd"]
    check(spark, rows, min_docs=2, top=7)


def test_slices_cut_at_spaces_only():
    text = b" aa bbb  cccccccccccc d " * 50
    for size in (1, 3, 7, 1000):
        assert [w for s in divergence.slices(text, size) for w in s] == text.split()
    assert list(divergence.slices(b"")) == []


def test_counts_beyond_64_bits_of_product(spark):
    df = spark.sql("select 9000000000000 as n, 18000000000001 as total, 7 as terms")
    assert df.select(divergence.share("n", "total", "terms", 1_000_000_000).alias("p")).first()["p"] == 1 + 10**9 * 9000000000001 // 18000000000008
