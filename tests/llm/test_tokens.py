"""Operator 12: the file format's round trip, words against whole texts, files in the order of ids."""

import random
import zlib

import numpy as np
import pyarrow.fs
import pytest

from tracewell.llm import token_blocks, token_output

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 5000])
def test_blocks_come_back(n):
    draw = np.random.default_rng(n)
    for ids in (draw.integers(0, 1 << 32, n), draw.integers(7, 8, n), draw.zipf(1.3, n) % 50_000, np.where(draw.random(n) < 0.03, 4_294_967_295, draw.integers(0, 9, n))):
        ids = ids.astype(np.uint32)
        for share in (0.5, 0.95, 1.0):
            b = token_blocks.encode(ids, share) if n else None
            assert n == 0 or (token_blocks.decode(b)[:n] == ids).all()
            assert n == 0 or share < 1 or b.odd.sum() == 0


def test_every_width():
    draw = np.random.default_rng(0)
    for width in range(1, 33):
        v = draw.integers(0, 1 << width, (3, token_blocks.BLOCK)).astype(np.uint32)
        words = token_blocks.pack(v, width)
        assert words.shape == (3, width * token_blocks.LANES) and (token_blocks.unpack(words, width) == v).all()


def test_outliers_stay_out_of_the_width():
    ids = np.full(1024, 1000, dtype=np.uint32) + np.arange(1024, dtype=np.uint32) % 16
    ids[[3, 700]] = 4_000_000_000
    b = token_blocks.encode(ids)
    assert (b.least.tolist(), b.width.tolist(), b.odd.tolist(), len(b.data)) == ([1000], [4], [2], 512 + 12)


def test_words_give_the_ids_of_the_whole_text(tokenizer):
    draw = random.Random(2)
    odd = ["it's", "IT'S", "don't'", "café", "café", "́", "ẛ̣", " ", " ", "\x1c", "\u0085", "<|endoftext|>", "<|start", "of|>", "123", "a1b2", "...", "中文", "\U0001f600", "ΣΑΣ", "İx", "ß", "Ünïcode,", "ÀÞÿ).", "word.", "K.", "Åb", "a.'s", "x!?…", "naïve'll", "×", "ª", "straße;", "a$%&*", "b<|endoftext|>", "<|ENDOFTEXT|>", "c|>_", "d_e", "\u00ad", "é\u0301", "\x00", "x" * 90]
    glue = [" ", "\n", "\t", "  ", "\r\n", "\x0b", "\x0c", ""]
    encoder = token_output.Encoder(PATH)
    for _ in range(600):
        text = "".join(draw.choice(odd) + draw.choice(glue) for _ in range(draw.randrange(12)))
        assert encoder.encode([text.encode()])[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, ascii(text)


def test_stretches_and_forgetting(tokenizer, monkeypatch):
    text = "one two\nthree   four'five \t six " * 40
    want = tokenizer.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(token_output, "KEPT_WORDS", 2)
    for size in (1, 5, 64):
        parts = list(token_output.stretches(text.encode(), size))
        assert b"".join(parts) == text.encode() and [w for p in parts for w in p.split()] == text.encode().split()
    monkeypatch.setattr(token_output, "STRETCH", 16)
    ids, n = token_output.Encoder(PATH).encode([text.encode(), b"", b" ", text.encode()])
    assert ids.tolist() == want * 2 and n.tolist() == [len(want), 0, 0, len(want)]


def rows_of(tokenizer, docs):
    return {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, token_output.END] for i, t in docs}


def test_files_hold_all_documents_in_order(spark, tokenizer, tmp_path):
    docs = [(i * 7 % 101, f"document number {i} " * (i % 13)) for i in range(101)] + [(500, None), (501, ""), (502, "long text " * 30_000)]
    df = spark.createDataFrame([(i, t, 1, b"x") for i, t in docs], "doc_id long, text string, start long, ids binary").repartition(3)
    path = f"file://{tmp_path}/out"
    token_output.write_tokens(df, path, PATH, fileIds=300)
    got = token_output.read_tokens(spark, path, readIds=1000).collect()
    want, at = rows_of(tokenizer, docs), 0
    assert sorted(r["doc_id"] for r in got) == sorted(want)
    for r in sorted(got, key=lambda r: r["doc_id"]):
        ids = np.frombuffer(r["ids"], dtype="<u4").tolist()
        assert (r["start"], r["n_tokens"], ids) == (at, len(ids), want[r["doc_id"]])
        at += len(ids)
    files = token_blocks.manifest(path)
    assert len(files) > 4 and sum(f["docs"] for f in files) == len(docs) and sum(f["ids"] for f in files) == at
    stored = token_blocks.Stored(pyarrow.fs.LocalFileSystem(), f"{tmp_path}/out/{files[-1]['name']}")
    assert stored.read(5, 2000).tolist() == [x for i in sorted(want) for x in want[i]][files[-1]["base"] :][5:2000]
    with pytest.raises(Exception, match="already"):
        token_output.write_tokens(df, path, PATH)


def test_repeated_null_and_no_rows(spark, tokenizer, tmp_path):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (None, "n"), (-5, "m")], "doc_id long, text string")
    token_output.write_tokens(df, f"{tmp_path}/a", PATH)
    got = sorted(token_output.read_tokens(spark, f"{tmp_path}/a").collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, -5, 1, 1, 1] and [r["start"] for r in got] == [0, 2, 4, 6, 8]
    token_output.write_tokens(df.limit(0), f"{tmp_path}/b", PATH)
    assert token_output.read_tokens(spark, f"{tmp_path}/b").count() == 0


def test_query_digests_the_files(spark, sf, tokenizer):
    got = token_output.op12_token_output(spark, sf)
    assert got.dtypes == [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")]
    docs, at = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()), 0
    want = rows_of(tokenizer, docs)
    for r in sorted(got.collect()):
        ids = want.pop(r["doc_id"])
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)
    assert not want
