"""Patched frame-of-reference blocks and token files.

A block holds 128 ids. Its minimum is subtracted, the differences are packed at
the width that holds the 90th percentile, and larger ones go to an exception
list of (place, difference). A file is: magic, blocks, block starts, document
table, footer; with the block starts a reader can begin at any block.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rasterloom.llm import common
from rasterloom.llm.tokens import encoder

BLOCK = 128
PERCENTILE = 0.9
MAGIC = b"RLPFOR01"
HEAD = np.dtype([("low", "<u4"), ("width", "u1"), ("outliers", "u1"), ("count", "<u2")])
HEAD_WORDS = HEAD.itemsize // 4
FOOTER = struct.Struct("<QQQQQ8s")  # blocks, ids, documents, start of block index, end id, magic
ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
CHUNK = 2048 * BLOCK


def _pack(rows: np.ndarray, width: int) -> np.ndarray:
    """(m, 128) values below 2**width as (m, 4 * width) little-endian words."""
    lanes = np.ascontiguousarray(rows.T)
    out = np.zeros((4 * width, rows.shape[0]), np.uint32)
    for j in range(BLOCK):
        word, bit = divmod(j * width, 32)
        out[word] |= lanes[j] << np.uint32(bit)
        if bit + width > 32:
            out[word + 1] |= lanes[j] >> np.uint32(32 - bit)
    return np.ascontiguousarray(out.T)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    lanes = np.ascontiguousarray(words.T)
    out = np.empty((BLOCK, words.shape[0]), np.uint32)
    mask = np.uint32(0xFFFFFFFF if width == 32 else (1 << width) - 1)
    for j in range(BLOCK):
        word, bit = divmod(j * width, 32)
        value = lanes[word] >> np.uint32(bit)
        if bit + width > 32:
            value = value | (lanes[word + 1] << np.uint32(32 - bit))
        out[j] = value & mask
    return np.ascontiguousarray(out.T)


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places start..start+length of each pair, one after another."""
    total = int(lengths.sum())
    first = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return first + np.arange(total)


def encode_blocks(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bytes of the blocks, and where each begins; a block is head, packed words, exceptions' places, their values, in whole words."""
    n = len(ids)
    if not n:
        return b"", np.empty(0, np.int64)
    blocks = -(-n // BLOCK)
    padded = np.empty(blocks * BLOCK, np.uint32)
    padded[:n] = ids
    padded[n:] = ids[-1]
    rows = padded.reshape(blocks, BLOCK)
    low = rows.min(axis=1)
    rows -= low[:, None]
    at = int(PERCENTILE * (BLOCK - 1))
    width = np.frexp(np.partition(rows, at, axis=1)[:, at].astype(np.float64))[1].astype(np.int64)
    over = rows > ((np.int64(1) << width) - 1).astype(np.uint32)[:, None]
    outliers = over.sum(axis=1)
    places = -(-outliers // 4)
    sizes = HEAD_WORDS + 4 * width + places + outliers
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    out = np.zeros(int(sizes.sum()), np.uint32)
    heads = np.zeros(blocks, HEAD)
    heads["low"], heads["width"], heads["outliers"], heads["count"] = low, width, outliers, BLOCK
    heads["count"][-1] = n - (blocks - 1) * BLOCK
    out[starts[:, None] + np.arange(HEAD_WORDS)] = heads.view(np.uint32).reshape(blocks, HEAD_WORDS)
    block, place = np.nonzero(over)
    if len(block):
        lists = starts + HEAD_WORDS + 4 * width
        out.view(np.uint8)[_spread(4 * lists, outliers)] = place
        out[_spread(lists + places, outliers)] = rows[block, place]
        rows[block, place] = 0
    for w in np.unique(width):
        if w:
            which = np.flatnonzero(width == w)
            out[(starts[which] + HEAD_WORDS)[:, None] + np.arange(4 * w)] = _pack(rows[which], int(w))
    return out.astype("<u4").tobytes(), 4 * starts


def decode_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """Ids of the blocks that begin at these places of ``data``."""
    blocks = len(starts)
    if not blocks:
        return np.empty(0, np.uint32)
    raw = np.frombuffer(data, "<u4", len(data) // 4)
    starts = np.asarray(starts, np.int64) // 4
    heads = raw[starts[:, None] + np.arange(HEAD_WORDS)].reshape(-1).view(HEAD)
    width, outliers = heads["width"].astype(np.int64), heads["outliers"].astype(np.int64)
    if width.max() > 32 or heads["count"].max() > BLOCK:
        raise ValueError("damaged block header")
    rows = np.zeros((blocks, BLOCK), np.uint32)
    for w in np.unique(width):
        if w:
            which = np.flatnonzero(width == w)
            rows[which] = _unpack(raw[(starts[which] + HEAD_WORDS)[:, None] + np.arange(4 * w)], int(w))
    if outliers.any():
        lists = starts + HEAD_WORDS + 4 * width
        place = raw.view(np.uint8)[_spread(4 * lists, outliers)]
        rows[np.repeat(np.arange(blocks), outliers), place] = raw[_spread(lists + -(-outliers // 4), outliers)]
    rows += heads["low"][:, None]
    if (heads["count"] == BLOCK).all():
        return rows.reshape(-1)
    return rows[np.arange(BLOCK) < heads["count"][:, None]]


def open_fs(uri: str):
    """pyarrow's file system and the path in it; the path has a scheme, see common.qualified."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):  # as Hadoop writes it
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


class TokenFileWriter:
    """Documents in, one file out; memory holds one chunk of ids."""

    def __init__(self, stream, end_id: int):
        self.stream, self.end_id = stream, end_id
        self.place = stream.write(MAGIC)
        self.pending: list[bytes] = []
        self.waiting = self.total = 0
        self.index: list[np.ndarray] = []
        self.keys: list[int | None] = []
        self.lengths: list[int] = []

    def add(self, key: int | None, ids: bytes) -> None:
        """ids: little-endian uint32; the end id is appended here."""
        self.pending += (ids, struct.pack("<I", self.end_id))
        self.keys.append(key)
        self.lengths.append(len(ids) // 4 + 1)
        self.waiting += len(ids) // 4 + 1
        if self.waiting >= CHUNK:
            self._flush(self.waiting - self.waiting % BLOCK)

    def _flush(self, n: int) -> None:
        ids = np.frombuffer(b"".join(self.pending), "<u4")
        for at in range(0, n, CHUNK):
            data, starts = encode_blocks(ids[at : min(n, at + CHUNK)])
            self.index.append(starts + self.place)
            self.stream.write(data)
            self.place += len(data)
        self.pending, self.waiting, self.total = [ids[n:].tobytes()], len(ids) - n, self.total + n

    def close(self) -> int:
        self._flush(self.waiting)
        index = np.concatenate([*self.index, np.empty(0, np.int64)]).astype("<u8")
        keys = np.array([common.NULL_ID if k is None else k for k in self.keys], "<i8")
        null = np.array([k is None for k in self.keys], np.uint8)
        tail = index.tobytes() + keys.tobytes() + null.tobytes() + np.array(self.lengths, "<u8").tobytes()
        self.stream.write(tail + FOOTER.pack(len(index), self.total, len(keys), self.place, self.end_id, MAGIC))
        return self.place + len(tail) + FOOTER.size


def read_token_file(source, size: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(key, start in this file, ids) of each document; memory holds one chunk and one document."""
    if size < len(MAGIC) + FOOTER.size:
        raise ValueError("truncated token file")
    source.seek(0)
    if source.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a token file")
    source.seek(size - FOOTER.size)
    blocks, total, docs, tail, end_id, magic = FOOTER.unpack(source.read(FOOTER.size))
    if magic != MAGIC or tail + 8 * blocks + 17 * docs + FOOTER.size != size:
        raise ValueError("damaged token file footer")
    source.seek(tail)
    index = np.frombuffer(source.read(8 * blocks), "<u8").astype(np.int64)
    keys = np.frombuffer(source.read(8 * docs), "<i8")
    null = np.frombuffer(source.read(docs), np.uint8)
    lengths = np.frombuffer(source.read(8 * docs), "<u8").astype(np.int64)
    if lengths.sum() != total:
        raise ValueError("lengths do not add up")
    held, have, block, start = [], 0, 0, 0
    for d in range(docs):
        need = int(lengths[d])
        while have < need:
            last = min(blocks, block + CHUNK // BLOCK)
            stop = int(index[last]) if last < blocks else tail
            source.seek(int(index[block]))
            ids = decode_blocks(source.read(stop - int(index[block])), index[block:last] - index[block])
            held.append(ids)
            have, block = have + len(ids), last
        if len(held) > 1:
            held = [np.concatenate(held)]
        ids, held = held[0][:need], [held[0][need:]]
        have -= need
        if ids[-1] != end_id:
            raise ValueError("a document does not end with the end id")
        yield (None if null[d] else int(keys[d])), start, ids
        start += need


def write_token_files(docs: DataFrame, tokenizer: str, out: str, *, key: str = "doc_id", text: str = "text", end_id: int = 0, rotate: int = 1 << 28) -> DataFrame:
    """Encode whole texts and write them in ascending key order, one or more files per range of keys.

    Returns the manifest (part, number, path, bytes, n_docs, n_ids), stored: a file counts once its
    row is there, so files of failed or repeated attempts are ignored. Null texts are empty,
    null keys come first, equal keys are ordered by a hash of the text, repeated rows stay; rows
    of one key may fill several ranges. A file of ``rotate`` ids is closed, which bounds its index.
    A very long text is encoded in pieces and may fill many blocks. An empty table gives no file and no row; other columns are not used.
    """
    spark = docs.sparkSession
    out = common.qualified(spark, out)
    open_fs(out)[0].create_dir(open_fs(out)[1], recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        writer = stream = path = None

        def closed() -> pa.RecordBatch:
            size = writer.close()
            stream.close()
            return pa.RecordBatch.from_pydict({"part": [task], "number": [number], "path": [path], "bytes": [size], "n_docs": [len(writer.keys)], "n_ids": [writer.total]})

        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for k, ids in zip(part.column(0).to_pylist(), encoder(tokenizer).encode_many(texts), strict=True):
                    if writer is None:
                        path = f"{out}/part-{task:06d}-{number:04d}-{uuid.uuid4().hex}.pfor"
                        fs, at = open_fs(path)
                        stream = fs.open_output_stream(at, compression=None)
                        writer = TokenFileWriter(stream, end_id)
                    writer.add(k, ids)
                    if writer.total + writer.waiting >= rotate:
                        yield closed()
                        writer, number = None, number + 1
        if writer is not None:
            yield closed()

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    # The row number keeps even equal rows from filling one range.
    order = [F.col("key").asc_nulls_first(), F.xxhash64(F.coalesce("text", F.lit(""))), F.monotonically_increasing_id()]
    ranged = rows.repartitionByRange(common.parts(spark), *order).sortWithinPartitions(*order[:2])
    return common.stored(ranged.mapInArrow(write, "part long, number long, path string, bytes long, n_docs long, n_ids long"), "pfor-manifest")


def read_token_files(manifest: DataFrame, each, schema: str) -> DataFrame:
    """Read the files back; ``each(key, start, ids)`` makes a row of ``schema`` for each document.

    Starts count from the first file: the sums over the manifest, a row per file.
    """
    before = W.orderBy("part", "number").rowsBetween(W.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.to_pylist():
                fs, at = open_fs(f["path"])
                rows: list[tuple] = []
                with fs.open_input_file(at) as source:
                    if source.size() != f["bytes"]:
                        raise ValueError(f"{f['path']} has {source.size()} bytes, not {f['bytes']}")
                    for key, start, ids in read_token_file(source, f["bytes"]):
                        rows.append(each(key, f["base"] + start, ids))
                        if len(rows) == 2000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    names = [x.split()[0] for x in schema.split(",")]
    kinds = [ARROW[x.split()[1]] for x in schema.split(",")]
    return files.select("path", "bytes", "base").repartition(max(1, common.parts(manifest.sparkSession)), "path").mapInArrow(read, schema)


def crc_row(key: int | None, start: int, ids: np.ndarray) -> tuple:
    return key, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4"))
