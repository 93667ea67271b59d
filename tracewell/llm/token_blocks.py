"""A binary file format for token ids: patched frame of reference in blocks (operator 12).

A block is 1024 ids. Its minimum is subtracted and the rest is packed at the width that a given share
of the block's values fits in; the values beyond it stand whole in the block's exception list, and
their low bits are packed like the others'. A file is its blocks one after the other and a footer:
where each block starts, its minimum, width and number of exceptions, and where each document starts.
So a stretch of documents is read by seeking to its first block.

``TokenBlocks`` is a Spark data source, ``token_blocks``. A write names its files in a manifest, which
its commit renames into place: tasks that are repeated, or lost with their executor, leave at most
files that nobody reads. Paths may be of any store that pyarrow knows (file, hdfs, s3, gs, abfs).
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

MAGIC = b"tokpfor1"
BLOCK = 1024
#: A block is packed as this many interleaved streams of 64 values, each ``width`` words long.
LANES = BLOCK // 64
#: Share of a block's values that have to fit in its width.
SHARE = 0.95
#: Ids of a file, about; a document is never split.
FILE_IDS = 1 << 26
#: Ids that a task reads, and of those that it decodes at once, about.
READ_IDS, BATCH_IDS = 1 << 23, 1 << 20
SCHEMA = "doc_id long, start long, n_tokens long, ids binary"
ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Blocks of values (n, 1024) as words (n, width * 16); bits above the width are dropped."""
    v = np.ascontiguousarray(values.reshape(-1, 64, LANES).transpose(1, 0, 2)).astype(np.uint64) & np.uint64((1 << width) - 1)
    out = np.zeros((width, v.shape[1], LANES), dtype=np.uint64)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        out[word] |= v[j] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= v[j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.transpose(1, 0, 2)).reshape(len(values), -1)


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    """Words (n, width * 16) as blocks of values (n, 1024)."""
    w = np.ascontiguousarray(words.reshape(-1, width, LANES).transpose(1, 0, 2))
    out = np.zeros((64, len(words), LANES), dtype=np.uint32)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        v = w[word] >> np.uint64(shift)
        if shift + width > 64:
            v |= w[word + 1] << np.uint64(64 - shift)
        out[j] = v & np.uint64((1 << width) - 1)
    return np.ascontiguousarray(out.transpose(1, 0, 2)).reshape(len(words), BLOCK)


def widths(rest: np.ndarray, share: float) -> np.ndarray:
    """For each block the least width that ``share`` of its values fit in."""
    bits = np.frexp(rest.astype(np.float64))[1]
    at = np.arange(len(rest))[:, None] * 33 + bits
    held = np.bincount(at.ravel(), minlength=len(rest) * 33).reshape(-1, 33).cumsum(axis=1)
    return (held >= np.ceil(share * BLOCK)).argmax(axis=1).astype(np.uint8)


@dataclass
class Blocks:
    """Encoded blocks: the bytes, and for each block its size, minimum, width and number of exceptions."""

    data: bytes
    size: np.ndarray
    least: np.ndarray
    width: np.ndarray
    odd: np.ndarray


def encode(ids: np.ndarray, share: float = SHARE) -> Blocks:
    """Blocks of ids; the last one is filled up with its least id."""
    fill = -len(ids) % BLOCK
    v = np.append(ids, np.full(fill, ids[len(ids) // BLOCK * BLOCK :].min() if fill else 0)).astype(np.uint32).reshape(-1, BLOCK)
    least = v.min(axis=1)
    rest = v - least[:, None]
    width = widths(rest, share)
    beyond = rest.astype(np.uint64) >> width.astype(np.uint64)[:, None] > 0
    block, at = np.nonzero(beyond)
    odd = beyond.sum(axis=1)
    size = width.astype(np.int64) * (8 * LANES) + odd * 6
    start = np.cumsum(size) - size
    data = np.zeros(int(size.sum()), dtype=np.uint8)
    for w in np.unique(width[width > 0]):
        own = np.flatnonzero(width == w)
        data[start[own, None] + np.arange(int(w) * 8 * LANES)] = pack(rest[own], int(w)).astype("<u8").view(np.uint8)
    # An exception list is its places, then its values.
    first = start + width.astype(np.int64) * (8 * LANES)
    nth = np.arange(len(block)) - (np.cumsum(odd) - odd)[block]
    data[(first[block] + 2 * nth)[:, None] + np.arange(2)] = at.astype("<u2").view(np.uint8).reshape(-1, 2)
    data[(first[block] + 2 * odd[block] + 4 * nth)[:, None] + np.arange(4)] = rest[block, at].astype("<u4").view(np.uint8).reshape(-1, 4)
    return Blocks(data.tobytes(), size, least, width, odd.astype(np.uint16))


def decode(b: Blocks) -> np.ndarray:
    """All ids of the blocks, with what the last one was filled up with."""
    data, width, odd = np.frombuffer(b.data, dtype=np.uint8), b.width.astype(np.int64), b.odd.astype(np.int64)
    start, rest = np.cumsum(b.size) - b.size, np.zeros((len(width), BLOCK), dtype=np.uint32)
    for w in np.unique(width[width > 0]):
        own = np.flatnonzero(width == w)
        rest[own] = unpack(np.ascontiguousarray(data[start[own, None] + np.arange(w * 8 * LANES)]).view("<u8").reshape(len(own), -1), int(w))
    block = np.repeat(np.arange(len(width)), odd)
    nth, first = np.arange(len(block)) - (np.cumsum(odd) - odd)[block], (start + width * (8 * LANES))[block]
    at = np.ascontiguousarray(data[(first + 2 * nth)[:, None] + np.arange(2)]).view("<u2").ravel()
    rest[block, at] = np.ascontiguousarray(data[(first + 2 * odd[block] + 4 * nth)[:, None] + np.arange(4)]).view("<u4").ravel()
    return (rest + b.least[:, None]).ravel()


#: The footer's columns, in order.
DOCS = [("doc", "<i8"), ("null", "u1"), ("start", "<u8")]
INDEX = [("at", "<u8"), ("least", "<u4"), ("width", "u1"), ("odd", "<u2")]
TAIL = struct.Struct("<QQQ8s")


class Writer:
    """Appends documents to one file, block by block; what it holds is less than a batch and the footer."""

    def __init__(self, fs: pa.fs.FileSystem, path: str, share: float):
        self.out, self.share, self.ids, self.docs = fs.open_output_stream(path), share, 0, 0
        self.left, self.at = np.zeros(0, dtype=np.uint32), len(MAGIC)
        self.columns: dict[str, list[np.ndarray]] = {name: [] for name, _ in DOCS + INDEX}
        self.out.write(MAGIC)

    def _put(self, **columns: np.ndarray) -> None:
        for name, values in columns.items():
            self.columns[name].append(values)

    def _flush(self, ids: np.ndarray) -> None:
        if len(ids):
            b = encode(ids, self.share)
            self._put(at=self.at + np.cumsum(b.size) - b.size, least=b.least, width=b.width, odd=b.odd)
            self.out.write(b.data)
            self.at += len(b.data)

    def add(self, doc: np.ndarray, null: np.ndarray, n: np.ndarray, ids: np.ndarray) -> None:
        self._put(doc=doc, null=null, start=self.ids + np.cumsum(n) - n)
        self.ids, self.docs = self.ids + len(ids), self.docs + len(doc)
        held = np.append(self.left, ids)
        full = len(held) // BLOCK * BLOCK
        self._flush(held[:full])
        self.left = held[full:]

    def close(self) -> None:
        self._flush(self.left)
        for name, kind in DOCS + INDEX:
            self.out.write(np.concatenate([np.zeros(0, dtype=kind), *self.columns[name]]).astype(kind).tobytes())
        self.out.write(TAIL.pack(self.docs, self.ids, self.at, MAGIC))
        self.out.close()


class Stored:
    """One file, opened for reading: its footer, and any stretch of its ids."""

    def __init__(self, fs: pa.fs.FileSystem, path: str):
        self.file = fs.open_input_file(path)
        size = self.file.size()
        self.docs, self.ids, at, magic = TAIL.unpack(self.file.read_at(TAIL.size, size - TAIL.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no file of token blocks")
        self.blocks, footer, self.columns = -(-self.ids // BLOCK), self.file.read_at(size - TAIL.size - at, at), {}
        at_end, done = at, 0
        for name, kind in DOCS + INDEX:
            many = self.docs if (name, kind) in DOCS else self.blocks
            self.columns[name] = np.frombuffer(footer, dtype=kind, count=many, offset=done)
            done += many * np.dtype(kind).itemsize
        self.at = np.append(self.columns["at"], at_end).astype(np.int64)
        self.start = np.append(self.columns["start"], self.ids).astype(np.int64)

    def read(self, first: int, last: int) -> np.ndarray:
        """The ids from ``first`` up to ``last``, by the blocks that hold them."""
        a, b = first // BLOCK, -(-last // BLOCK)
        if a >= b:
            return np.zeros(0, dtype=np.uint32)
        c, at = self.columns, self.at
        ids = decode(Blocks(self.file.read_at(int(at[b] - at[a]), int(at[a])), np.diff(at[a : b + 1]), c["least"][a:b], c["width"][a:b], c["odd"][a:b]))
        return ids[first - a * BLOCK : last - a * BLOCK]


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: its place among the tasks, and (file, documents, ids) in order."""

    task: int
    files: list[tuple[str, int, int]]


@dataclass
class Stretch(InputPartition):
    """The documents of a file whose first id is in [first, last); ``base`` ids stand before the file."""

    name: str
    base: int
    first: int
    last: int


def _open(path: str) -> tuple[pa.fs.FileSystem, str]:
    fs, at = pa.fs.FileSystem.from_uri(path)
    return fs, at.rstrip("/")


def manifest(path: str) -> list[dict]:
    """The files of a committed write in order: name, docs, ids and base, the ids before it."""
    fs, at = _open(path)
    with fs.open_input_stream(f"{at}/_manifest.json") as f:
        return json.loads(f.readall())["files"]


class _Sink(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.share, self.most = options["path"], float(options.get("share", SHARE)), int(options.get("fileids", FILE_IDS))
        self.overwrite, self.run = overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        (fs, at), files, to = _open(self.path), [], None

        def end() -> None:
            to.close()
            files.append((name, to.docs, to.ids))

        fs.create_dir(at, recursive=True)
        for batch in iterator:
            doc, ids = batch.column("doc_id"), batch.column("ids").cast(pa.large_binary())
            offsets = np.frombuffer(ids.buffers()[1], dtype=np.int64)[ids.offset : ids.offset + len(ids) + 1] if len(ids) else np.zeros(1, dtype=np.int64)
            flat = np.frombuffer(ids.buffers()[2] or b"", dtype=np.uint8)
            n = np.diff(offsets) // 4
            # Several files if the batch passes the limit; a document belongs to the file that its first id falls into.
            done = 0
            while done < len(doc):
                if to is None:
                    name = f"part-{context.partitionId():06d}-{len(files):04d}-{context.taskAttemptId()}-{self.run}.tok"
                    to = Writer(fs, f"{at}/{name}", self.share)
                fit = int(np.searchsorted(to.ids + np.cumsum(n[done:]) - n[done:], self.most, side="left"))
                part = slice(done, done + fit)
                if fit:
                    held = doc.slice(done, fit)
                    to.add(held.fill_null(0).to_numpy(zero_copy_only=False), held.is_null().to_numpy(zero_copy_only=False).astype(np.uint8), n[part], flat[offsets[done] : offsets[done + fit]].view("<u4"))
                    done += fit
                if to.ids >= self.most:
                    end()
                    to = None
        if to is not None:
            end()
        return Written(context.partitionId(), files)

    def commit(self, messages: list[Written | None]) -> None:
        (fs, at), files, base = _open(self.path), [], 0
        fs.create_dir(at, recursive=True)
        for name, docs, ids in (f for m in sorted((m for m in messages if m), key=lambda m: m.task) for f in m.files):
            files.append({"name": name, "docs": docs, "ids": ids, "base": base})
            base += ids
        old = fs.get_file_info(f"{at}/_manifest.json").type != pa.fs.FileType.NotFound
        if old and not self.overwrite:
            raise ValueError(f"{self.path} holds token blocks already")
        gone = manifest(self.path) if old else []
        with fs.open_output_stream(f"{at}/_manifest-{self.run}.json") as f:
            f.write(json.dumps({"files": files}).encode())
        fs.move(f"{at}/_manifest-{self.run}.json", f"{at}/_manifest.json")
        for f in gone:
            fs.delete_file(f"{at}/{f['name']}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, at = _open(self.path)
        for name, *_ in (f for m in messages if m for f in m.files):
            fs.delete_file(f"{at}/{name}")


class _Source(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("readids", READ_IDS))

    def partitions(self) -> list[Stretch]:
        return [Stretch(f["name"], f["base"], a, min(a + self.most, f["ids"]) if a + self.most < f["ids"] else f["ids"] + 1) for f in manifest(self.path) for a in range(0, max(1, f["ids"]), self.most)]

    def read(self, partition: Stretch | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no files
            return
        fs, at = _open(self.path)
        f = Stored(fs, f"{at}/{partition.name}")
        a, b = np.searchsorted(f.start[:-1], [partition.first, partition.last])
        while a < b:
            end = min(b, max(a + 1, int(np.searchsorted(f.start, f.start[a] + min(self.most, BATCH_IDS), side="right")) - 1))
            start, data = f.start[a : end + 1], f.read(int(f.start[a]), int(f.start[end]))
            ids = pa.Array.from_buffers(pa.large_binary(), int(end - a), [None, pa.py_buffer((4 * (start - start[0])).tobytes()), pa.py_buffer(data.astype("<u4").tobytes())])
            doc = pa.array(f.columns["doc"][a:end], mask=f.columns["null"][a:end].astype(bool))
            yield pa.record_batch([doc, pa.array(partition.base + start[:-1]), pa.array(np.diff(start)), ids.cast(pa.binary())], schema=ARROW)
            a = end


class TokenBlocks(DataSource):
    """``token_blocks``: documents' token ids in files of packed blocks.

    It writes the columns doc_id (long) and ids (binary: unsigned 32-bit integers, little-endian) in the
    order of the partitions and of their rows, and reads (doc_id, start, n_tokens, ids), where ``start``
    counts the ids of all documents before. Options of a write: ``share``, ``fileIds``; of a read: ``readIds``.
    """

    @classmethod
    def name(cls) -> str:
        return "token_blocks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Source(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Sink(self.options, overwrite)
