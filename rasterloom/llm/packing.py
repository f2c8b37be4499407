"""Best-fit decreasing packing of token pieces into sequences of fixed capacity.

Pieces of one length are interchangeable, and so are open bins of one remaining
capacity. So the packing is computed on the histogram of lengths, which has at
most ``capacity`` entries whatever the corpus: lengths in decreasing order, each
going to the tightest open bins, found in a segment tree over remaining
capacities. The result is what one-by-one best-fit decreasing gives. Runs of
bins are kept as intervals of bin numbers, and a piece finds its bin by its rank
among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rasterloom.llm import common
from rasterloom.llm.tokens import KEPT, encoder


class CapacityTree:
    """Segment tree over remaining capacities 0..capacity; a leaf is set while bins of it are open."""

    def __init__(self, capacity: int):
        self.leaves = 1
        while self.leaves <= capacity:
            self.leaves *= 2
        self.any = [False] * (2 * self.leaves)

    def set(self, at: int, value: bool) -> None:
        i = at + self.leaves
        self.any[i] = value
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        """The smallest open capacity of at least ``need``."""
        i = need + self.leaves
        if self.any[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, pieces, first bin, offset): the pieces of these ranks go to consecutive bins."""
    tree, open_bins = CapacityTree(capacity), [deque() for _ in range(capacity + 1)]
    bins, plan = 0, []
    for length in sorted(counts, reverse=True):
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} is outside 1..{capacity}")
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, n = capacity, max(1, left // (capacity // length))
                open_bins[room].append((bins, n))
                bins += n
                tree.set(room, True)
            first, n = open_bins[room].popleft()
            # One by one, a bin takes all pieces of this length that fit before the next bin gets any.
            take = min(n, max(1, left // (room // length)))
            if take < n:
                open_bins[room].appendleft((first + take, n - take))
            if not open_bins[room]:
                tree.set(room, False)
            plan.append((length, rank, take, first, capacity - room))
            if room > length:
                open_bins[room - length].append((first, take))
                tree.set(room - length, True)
            rank, left = rank + take, left - take
    return plan


def token_pieces(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", end_id: int = 2, capacity: int = 1024, kept: int = KEPT) -> DataFrame:
    """Pieces of at most ``capacity`` ids of each document, its end id included; stored.

    Only longer documents are cut; the first piece is the shorter one. ``part`` and
    ``place`` number the pieces of one length within the task that made them.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for i in range(0, batch.num_rows, 250):
                rows = batch.slice(i, 250)
                texts = [t or "" for t in rows.column(1).to_pylist()]
                out: list[tuple] = []
                for k, ids in zip(rows.column(0).to_pylist(), encoder(tokenizer, kept).encode_many(texts), strict=True):
                    ids += end
                    n = len(ids) // 4
                    edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    for p in range(len(edges) - 1):
                        a, b = edges[p], edges[p + 1]
                        out.append((k, p, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), part, seen[b - a]))
                        seen[b - a] += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
        common.trim()

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    with common.small_reads(docs.sparkSession):
        return common.stored(rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"), "pieces")


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Give each piece (length, part, place) its sequence_id and offset."""
    per_part = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    base = per_part.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    # At most ``capacity`` rows, whatever the corpus.
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    steps = np.array(best_fit_decreasing(counts, capacity), np.int64).reshape(-1, 5)
    # A step per length and interval of equal bins: bounded by the square of the capacity, whatever the corpus.
    shared = pieces.sparkSession.sparkContext.broadcast((steps, {int(x): (int(a), int(b)) for x, a, b in zip(*_runs(steps[:, 0]), strict=True)}))
    ranked = pieces.join(base, ["length", "part"]).withColumn("rank", F.col("base") + F.col("place")).drop("base", "part", "place")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, first = shared.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for x in np.unique(length):
                a, b = first[int(x)]
                which = np.flatnonzero(length == x)
                step = a + np.searchsorted(plan[a:b, 1], rank[which], side="right") - 1
                sequence[which] = plan[step, 3] + rank[which] - plan[step, 1]
                offset[which] = plan[step, 4]
            cols = [batch.column(c) for c in kept] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(cols, names=[*kept, "sequence_id", "offset"])

    kept = [c for c in ranked.columns if c != "rank"]
    schema = ranked.select(*kept).schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(place, schema)


def _runs(sorted_desc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(sorted_desc):
        return sorted_desc, sorted_desc, sorted_desc
    a = np.flatnonzero(np.concatenate(([True], sorted_desc[1:] != sorted_desc[:-1])))
    return sorted_desc[a], a, np.concatenate((a[1:], [len(sorted_desc)]))


def pack_documents(docs: DataFrame, tokenizer: str, *, capacity: int = 1024, end_id: int = 2, key: str = "doc_id", text: str = "text", kept: int = KEPT) -> DataFrame:
    """Pack every document; see token_pieces and pack. Empty and null texts are pieces of the end id alone;
    repeated rows are packed each; an empty table gives no rows; other columns are not used."""
    pieces = token_pieces(docs, tokenizer, key=key, text=text, end_id=end_id, capacity=capacity, kept=kept)
    return pack(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
