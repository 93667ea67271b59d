"""Operators on small frames: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from tracewell.llm import ann, chat, decontam, mixing, near_duplicates, quality, secrets, sharding, simhash_dedup, suffix_dedup, url_templates
from tracewell.llm.common import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, host string"
LONG = "word " * 30_000


def docs(spark, *rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 0.0, "h") for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, (1, "alpha beta gamma delta epsilon", "a"), (1, "alpha beta gamma delta epsilon", "a"), (2, None, "b"), (3, "", None), (None, "one two three", "b"), (4, " \n\t ", "c"), (5, LONG, "a"), (6, "alpha beta gamma delta epsilon", None))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_mixing(spark, odd, none):
    got = mixing.taken_words(odd, block=4, slots=8).collect()
    assert len(got) == 8 and mixing.taken_words(none).count() == 0
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    total = sum(r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    assert abs(sum(t for _, t in by) - total) < 1e-6
    assert sum(r["taken"] for r in got) == pytest.approx(total, abs=4)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.taken_words(odd, block=4, slots=8).collect()), key=repr)
    rows = mixing.mixed_documents(odd, block=4, slots=8)
    assert rows.columns == odd.columns
    assert sum(len(r["text"].split()) for r in rows.collect()) == sum(r["taken"] for r in got)


def test_mixing_hits_targets(spark):
    rows = [(i, " ".join(["w"] * (5 + i * 7 % 40)), f"s{i % 5}" if i % 3 else "big") for i in range(300)]
    got = mixing.taken_words(docs(spark, *rows), block=8, slots=16)
    source = {i: s for i, _, s in rows}
    taken, target = {}, {}
    for r in got.collect():
        taken[source[r["doc_id"]]] = taken.get(source[r["doc_id"]], 0) + r["taken"]
        target[source[r["doc_id"]]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)


def test_decontamination(spark, odd, none):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon"), (2, None), (3, "")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in decontam.leaks(odd, bench).collect())
    assert got == [(1, 1), (1, 1), (6, 1)]
    assert sorted((r["doc_id"], r["item_id"]) for r in decontam.leaks(odd, bench.unionAll(bench), index_words=3).collect()) == sorted(got * 2)
    assert decontam.leaks(none, bench).count() == 0 and decontam.leaks(odd, bench.limit(0)).count() == 0
    clean = decontam.without_leaks(odd, bench)
    assert clean.columns == odd.columns and clean.count() == 5


def test_quality(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (5, None, 0), (77, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    for l in (labels, labels.limit(0)):
        out = quality.with_scores(odd, quality.fit(odd, l))
        assert out.columns == odd.columns and all(0 <= r["score"] <= 1 for r in out.collect())
    assert quality.with_scores(none, quality.fit(none, labels)).count() == 0


def test_suffix(spark, odd, none):
    got = suffix_dedup.repeated_spans(odd, width=8, seed=4).collect()  # repeated ids, null texts, a long text
    assert len(got) == 8 and suffix_dedup.repeated_spans(none).count() == 0
    assert [(r["doc_id"], [tuple(s) for s in r["spans"]]) for r in got if r["spans"]] == [(6, [(0, 30)])]
    rows = [(i, ("abcd" * (i % 7) + f"{i % 5} and the rest of it {i % 3}") * (1 + i % 4), "s") for i in range(60)]
    want = suffix_dedup.brute_spans([(i, t.encode()) for i, t, _ in rows])
    for group, digit, bucket in ((200, 900, 300), (1 << 20, 1 << 20, 1 << 20)):
        got = suffix_dedup.repeated_spans(docs(spark, *rows), group_bytes=group, digit_bytes=digit, bucket_bytes=bucket).collect()
        assert {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in got} == want


def test_secrets(spark, none):
    key = "password = " + "x" * 20
    rows = docs(spark, (1, key, "a"), (1, key, "a"), (2, None, "a"), (3, "", "a"), (None, LONG + key, "a"))
    got = sorted((r["doc_id"] or 0, [tuple(s) for s in r["spans"]]) for r in secrets.find_secrets(rows).collect())
    n = len(LONG)
    assert got == [(0, [("assign", n, n + 31)]), (1, [("assign", 0, 31)]), (1, [("assign", 0, 31)]), (2, []), (3, [])]
    assert secrets.find_secrets(none).count() == 0


def test_nearest(spark):
    schema = "vec_id long, embedding array<double>, score double"
    rows = [(0, [1.0, 0.0], 0.0), (1, [2.0, 0.0], 0.0), (2, [2.0, 0.0], 0.0), (3, [0.0, 1.0], 0.0), (4, None, 0.0), (5, [0.0, 0.0], 0.0), (6, [1.0, None], 0.0), (7, [float("nan"), 1.0], 0.0), (8, [float("inf"), 1.0], 0.0), (9, [1.0, 1.0, 1.0], 0.0), (None, [1.0, 0.0], 0.0), (3, [0.0, 1.0], 0.0), (10, [], 0.0)]
    df = spark.createDataFrame(rows, schema)
    got = [tuple(r) for r in ann.nearest(df, df.where("vec_id in (0, 4, 5, 7)")).orderBy("query_id", "rank").collect()]
    assert [(q, r, v) for q, r, v, _ in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 3)] and got[0][3] == 1.0
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0
    import numpy as np

    v = np.random.default_rng(2).normal(size=(400, 16))
    df = spark.createDataFrame([(i, x.tolist(), 0.0) for i, x in enumerate(v)], schema)
    found = {(r["query_id"], r["vec_id"]) for r in ann.nearest(df, df.where("vec_id % 50 = 0"), cell=100, block=60, query_block=3).collect()}
    want = {(q, c) for q, _, c in ann.brute(np.arange(400), v, range(0, 400, 50))}
    assert len(found & want) / len(want) >= 0.9


def test_simhash(spark, odd, none):
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in simhash_dedup.components(odd).collect())
    assert got == [(0, None), (1, 1), (1, 1), (2, 2), (3, 2), (4, 2), (5, 5), (6, 1)]
    assert simhash_dedup.components(none).count() == 0


def test_links_of_crowded_anchors(spark, monkeypatch):
    fps = [0] + [1 << i for i in range(63)] + [0b111, 0b1111, 0b110011 << 30, 7 << 50 | 7 << 20]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = plain_components(fps)
    for crowd in (2, 64):
        monkeypatch.setattr(simhash_dedup, "CROWD", crowd)
        got = {r["node"]: r["component"] for r in connected_components(simhash_dedup.links(df)).collect()}
        assert {f: got.get(f, f) for f in fps} == want


def plain_components(fps):
    label = {f: f for f in fps}
    while True:
        new = {f: min(label[g] for g in fps if bin(f ^ g).count("1") <= 2) for f in fps}
        if new == label:
            return label
        label = new


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (100, 100)], "src long, dst long")
    got = {r["node"]: r["component"] for r in connected_components(e).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_near_duplicates(spark, odd, none):
    words = [f"w{i}" for i in range(120)]
    near, far = list(words), list(words)
    near[60] = "x"
    far[::9] = ["y"] * len(far[::9])
    rows = docs(spark, (10, " ".join(near), "a"), (9, " ".join(words), "a"), (11, " ".join(far), "a"), (12, " ".join(words), "b"))
    assert sorted(r["doc_id"] for r in near_duplicates.drop_near_duplicates(rows).collect()) == [9, 11]
    kept = near_duplicates.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 5]
    assert near_duplicates.drop_near_duplicates(none).count() == 0


def test_sharding(spark, odd, none, tmp_path):
    got = sharding.shard_documents(odd, small_rows=2, target=100_000)
    assert got.count() == 8 and sharding.shard_documents(none).count() == 0
    s = sharding.Store(spark, str(tmp_path / "s"), target=1_000_000, small_rows=2)
    assert s.append(odd) == 1 and s.append(odd) == 2 and s.manifest().count() >= 8
    assert s.compact() == 3 and s.manifest().count() == 1 and s.compact() == 3
    assert s.read().count() == 16 and s.read(1).count() == 8
    with pytest.raises(sharding.Conflict):
        s.commit(s.manifest(), 3)


URLS = ["https://A.Example.org/es/1", "https://example.org/en/12", "http://example.org/en/2", None, "no scheme", "https://x.com/fr/1?q#f", "https://x.com/de/1", "https://org", "https://y.net/a/7", "https://notexample.org/es/1", "https://x.com/en/1.html", "https://x.com"]


def duck(pages=(), turns=()):
    c = duckdb.connect()
    c.execute("create table pages (page_id bigint, url varchar); create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    for p in pages:
        c.execute("insert into pages values (?, ?)", list(p))
    for t in turns:
        c.execute("insert into conversations values (?, ?, ?, ?)", list(t))
    return c


def same(df, c, sql):
    r = c.execute(sql)
    cols = [d[0] for d in r.description]
    want = sorted((tuple(x) for x in r.fetchall()), key=repr)
    assert sorted((tuple(x[k] for k in cols) for x in df.select(*cols).collect()), key=repr) == want
    return want


def test_url_templates(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(100 + i, f"https://h{i % 3}.com/{['fr', 'de', 'en', 'x'][i % 4]}/{i}") for i in range(300)]
    df = spark.createDataFrame([(i, u, "clash", "clash") for i, u in rows], "page_id long, url string, host string, rule string")
    cols = ["page_id", "host", "path", "rule", "template", "verdict"]
    out = url_templates.judge(df).select(*cols)
    same(out, duck(pages=rows), url_templates.oracle())
    by = {r["page_id"]: r for r in out.collect()}
    assert (by[0]["host"], by[0]["rule"], by[0]["verdict"]) == ("a.example.org", "example.org/es/", "block")
    assert by[1]["rule"] == "example.org/en/1" and by[2]["rule"] == "org/" and by[9]["rule"] == "org/" and by[7]["rule"] is None
    assert by[3]["host"] == by[4]["path"] == ""
    assert url_templates.judge(df.limit(0)).count() == 0


def test_chat(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 1, "assistant", "yo"), (1, 70, "bob", None), (2, 0, "system", "rules"), (3, None, None, "<|im_end|> x"), (None, 0, "a", "t"), (1, 0, "system", "sys")]
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, part int")
    got = chat.perspectives(df)
    rows = same(got, duck(turns=turns), chat.oracle())
    assert len(rows) == 6 + 1 + 1 + 1
    for r in got.collect():
        runs = [tuple(map(int, x.split(":"))) for x in r["mask"].split(",")]
        assert sum(n for n, _ in runs) == len(r["text"]) and sum(n * f for n, f in runs) == r["n_trained"]
    assert chat.perspectives(df.limit(0)).count() == 0
    assert json.dumps([r["text"] for r in got.where("conv_id = 3").collect()]).count("< |im_end|>") == 1


def test_sharding_keeps_columns_of_any_name(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i}", "p", "r", "s", {"m": i}) for i in range(40)], "doc_id long, text string, path string, run string, shard string, _metadata map<string,int>")
    out = sharding.shard_documents(rows.repartition(8), str(tmp_path / "store"), target=1 << 20, small_rows=3)
    assert sorted(r["doc_id"] for r in out.collect()) == list(range(40)) and out.select("shard").distinct().count() == 1
    back = sharding.Store(spark, str(tmp_path / "store")).read(None, "file")
    assert sorted((r["doc_id"], r["text"], r["path"], r["run"], r["shard"], r["_metadata"]["m"]) for r in back.collect()) == [(i, f"t{i}", "p", "r", "s", i) for i in range(40)]


def test_pipeline_runs_whole(spark, sf, tmp_path):
    """Every stage's decisions take effect: the shards hold the words that mixing took of what the stages before kept."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept.count()
        kept = stage(spark, kept, sf)
        kept.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        assert kept.columns == docs.columns and (name == "mixing" or kept.count() < before)
    out = corpus_pipeline.run(spark, sf, str(tmp_path / "corpus"))
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(r["doc_id"] for r in kept.collect())
    store = sharding.Store(spark, str(tmp_path / "corpus"))
    assert sorted(r["text"] for r in store.read().collect()) == sorted(r["text"] for r in kept.collect())


def test_quality_on_held_out_rows(spark, sf):
    """Held-out labels: the area under the curve, by ranks."""
    scored = quality.op5_quality(spark, "/root/testdata/sf0.01").where("held_out")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality is not null").select("doc_id", "quality")
    rows = sorted((r["score"], r["quality"]) for r in scored.join(labels, "doc_id").collect())
    ranks = [i + 1 for i, (_, q) in enumerate(rows) if q == 1]
    good, bad = len(ranks), len(rows) - len(ranks)
    assert good and bad and (sum(ranks) - good * (good + 1) / 2) / (good * bad) >= 0.95
