"""Documents as token ids in binary files, in the order of their ids (operator 12).

The files' format is ``token_blocks``. The tokenizer is a parameter; it has to drop white space, as one
with word ends does, for then a text's ids are those of its words one after the other, and a word that
a task has met is not encoded again.
"""

from __future__ import annotations

import functools
import gc
import os
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import arrow_rows, scratch_path
from tracewell.llm.token_blocks import TokenBlocks

#: The id that ends a document.
END = 1
#: Bytes of a text that are taken apart at once.
STRETCH = 1 << 20
#: Words and ids that a worker keeps encoded.
KEPT_WORDS, KEPT_IDS = 400_000, 3_000_000
SPACE = re.compile(rb"[\x09-\x0d\x20]")
#: A line of small Latin letters, which stay as they are, and punctuation that no contraction and no special token begins with.
LATIN = re.compile("(?m)^(?:([a-zß-öø-ÿ]+)([!-&(-/:;=-@[-`{-~]*)|[^\\n]*)$")
#: How byte-level vocabularies write the bytes of these letters: printable ones stand for themselves, others move up.
BYTE_LEVEL = {c: "".join(chr(b) if 0x21 <= b <= 0x7E or 0xA1 <= b != 0xAD else chr(0x100 + [*range(0x21), *range(0x7F, 0xA1), 0xAD].index(b)) for b in chr(c).encode()) for c in range(0xC0, 0x100)}


def stretches(text: bytes, size: int = STRETCH) -> Iterator[bytes]:
    """The text in parts of ``size`` bytes or a little more, that end before white space."""
    at = 0
    while at < len(text):
        found = SPACE.search(text, at + size)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


class Lists:
    """Lists of ids by number, in two arrays that grow."""

    def __init__(self):
        self.ids, self.ends, self.many, self.size = np.zeros(1 << 16, dtype=np.uint32), np.zeros(1 << 16, dtype=np.int64), 0, 0

    def add(self, ids: np.ndarray, n: np.ndarray) -> None:
        while len(self.ids) < self.size + len(ids):
            self.ids = np.append(self.ids, np.zeros_like(self.ids))
        while len(self.ends) <= self.many + len(n):
            self.ends = np.append(self.ends, np.zeros_like(self.ends))
        self.ids[self.size : self.size + len(ids)] = ids
        self.ends[self.many + 1 : self.many + 1 + len(n)] = self.size + np.cumsum(n)
        self.many, self.size = self.many + len(n), self.size + len(ids)

    def get(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists' ids one after the other, and how many each has."""
        first = self.ends[k]
        n = self.ends[k + 1] - first
        return self.ids[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())], n


class Encoder:
    """The ids of texts, each word encoded once while it is kept.

    A word of Latin letters, with or without punctuation behind it, is what the tokenizer's normaliser and
    pre-tokenizer make of it (``plain``), so its model is asked at once; other words take the whole way.
    """

    def __init__(self, path: str, plain: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.plain = Tokenizer.from_file(path), plain
        self.model = self.tokenizer.model
        self._empty()

    def _empty(self) -> None:
        self.words: dict[bytes, int] = {}
        self.parts: dict[str, int] = {"": 0}
        self.of_words, self.of_parts = Lists(), Lists()
        self.of_parts.add(np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64))

    def _whole(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, parts: set[str], ids) -> None:
        """Keeps the ids of those of the parts that are new."""
        if new := list(parts.difference(self.parts)):
            found = ids(new)
            self.parts.update(zip(new, range(len(self.parts), len(self.parts) + len(new)), strict=True))
            self.of_parts.add(np.fromiter(chain.from_iterable(found), dtype=np.uint32), np.fromiter(map(len, found), dtype=np.int64, count=len(new)))

    def _keep(self, words: list[bytes]) -> None:
        lines = b"\n".join(words).decode()
        letters, behind = zip(*(LATIN.findall(lines.lower()) if self.plain else [("", "")] * len(words)), strict=True)
        tokenize = self.model.tokenize
        self._learn(set(letters), lambda new: [[t.id for t in tokenize(x if x.isascii() else x.translate(BYTE_LEVEL))] for x in new])
        self._learn(set(behind), self._whole)
        # Other words are one part, as they are.
        rest = {k: w.decode() for k, (w, x) in enumerate(zip(words, letters, strict=True)) if not x}
        self._learn(set(rest.values()), self._whole)
        of = np.array([np.fromiter(map(self.parts.__getitem__, x), dtype=np.int64, count=len(words)) for x in (letters, behind)])
        of[0, list(rest)] = [self.parts[w] for w in rest.values()]
        ids, n = self.of_parts.get(of.T.ravel())
        self.of_words.add(ids, n.reshape(-1, 2).sum(axis=1))
        self.words.update(zip(words, range(len(self.words), len(self.words) + len(words)), strict=True))

    def _words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids one after the other, and how many each has."""
        k = np.fromiter(map(self.words.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        if len(unknown := np.flatnonzero(k < 0)):
            unknown, get = unknown.tolist(), words.__getitem__
            gc.disable()  # so many small tuples start it again and again, and none is in a cycle
            try:
                self._keep(list(set(map(get, unknown))))
            finally:
                gc.enable()
            k[unknown] = np.fromiter(map(self.words.__getitem__, map(get, unknown)), dtype=np.int64, count=len(unknown))
        out = self.of_words.get(k)
        if len(self.words) > KEPT_WORDS or self.of_words.size > KEPT_IDS:
            self._empty()
        return out

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after the other, and how many each text has; about ``STRETCH`` bytes at once."""
        ids, of, n, held, docs, size = [np.zeros(0, dtype=np.uint32)], [], [], [], [], 0

        def flush() -> None:
            got, many = self._words(list(chain.from_iterable(held)))
            ids.append(got)
            of.append(np.repeat(docs, [len(w) for w in held]))
            n.append(many)

        for k, text in enumerate(texts):
            # Case makes no difference but in the names of special tokens.
            for part in stretches(text if b"<|" in text else text.lower()):
                held.append(part.split())
                docs.append(k)
                size += len(part)
                if size >= STRETCH:
                    flush()
                    held, docs, size = [], [], 0
        if held:
            flush()
        total = np.bincount(np.concatenate(of), weights=np.concatenate(n), minlength=len(texts)) if of else np.zeros(len(texts))
        return np.concatenate(ids), total.astype(np.int64)


@functools.cache
def encoder(path: str) -> Encoder:
    """A worker's encoder, which its tasks share."""
    return Encoder(path)


def encoded(docs: DataFrame, tokenizer: str, end: int | None = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) in ascending order of doc_id over all partitions; ids are bytes of unsigned 32-bit
    integers, little-endian, with ``end`` behind each document's.

    Null texts are empty: the end id alone. Rows with a null id come first; rows of one id stand in
    order of a hash of the text and the text, and may fill several partitions. Whole texts are encoded,
    however long; other columns are not read. No rows: no rows.
    """
    arrow_rows(docs.sparkSession, 500)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n = encoder(tokenizer).encode(batch.column("text").cast(pa.binary()).to_pylist())
            if end is not None:
                ids, n = np.insert(ids, np.cumsum(n), end), n + 1
            offsets = np.append(0, np.cumsum(n) * 4).astype(np.int64)
            held = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())])
            yield pa.record_batch([batch.column("doc_id"), held.cast(pa.binary())], names=["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    return rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie").mapInArrow(run, "doc_id long, ids binary")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int | None = END, **options) -> None:
    """Writes the documents' ids as ``token_blocks`` files in ascending order of doc_id."""
    docs.sparkSession.dataSource.register(TokenBlocks)
    encoded(docs, tokenizer, end).write.format("token_blocks").mode("append").options(**options).save(path)


def read_tokens(spark: SparkSession, path: str, **options) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of what ``write_tokens`` wrote."""
    spark.dataSource.register(TokenBlocks)
    return spark.read.format("token_blocks").options(**options).load(path)


def op12_token_output(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
