"""N-gram Jaccard join with Bayesian pruning of candidates.

Texts with the same set of word shingles are one class. Classes whose MinHash
values agree in a band share a bucket. Within a bucket, pairs compare their
MinHash values a few at a time and are dropped once the posterior probability
that their similarity reaches the threshold is below a tolerance. What is left
joins classes into blocks, and within a block the similarity of the shingle sets
is computed exactly. Pairs are never emitted: a bucket or block gives one link
per class to its group's least class, and a count of links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterloom.llm import common
from rasterloom.llm.components import components

SIZE = 5
THRESHOLD = 0.8
BANDS, ROWS = 26, 5
STEP = 13
#: A pair is dropped when the posterior probability of reaching the threshold is below this.
TOLERANCE = 1e-6
#: Members of a bucket, and of a block of whole texts, that one task compares with as many others.
SIGNATURE_CELL, CELL = 256, 1024


def least_matches(threshold: float, tolerance: float, hashes: int, step: int) -> np.ndarray:
    """For each number of compared values, the matches that a pair needs to stay.

    With a uniform prior the posterior of the similarity after m matches of n is
    Beta(m + 1, n - m + 1), and its tail beyond t is P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(step, hashes + 1, step):
        tail, m = 0.0, -1
        while tail < tolerance and m < n:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return np.array(out)


def surviving_pairs(signatures: np.ndarray, left: np.ndarray, right: np.ndarray, needed: np.ndarray, step: int) -> np.ndarray:
    """Which pairs of rows stay after the incremental comparison."""
    alive = np.arange(len(left))
    matches = np.zeros(len(left), np.int32)
    for k, least in enumerate(needed):
        if not len(alive):
            break
        part = slice(k * step, (k + 1) * step)
        matches = matches + (signatures[left[alive], part] == signatures[right[alive], part]).sum(axis=1, dtype=np.int32)
        stay = matches >= least
        alive, matches = alive[stay], matches[stay]
    return alive


class Union:
    """Groups of 0..n-1 by links; a group's root is its least member."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        p = self.parent
        while True:
            ra, rb = p[a], p[b]
            low = np.minimum(ra, rb)
            differ = ra != rb
            if not differ.any():
                return
            np.minimum.at(p, np.maximum(ra, rb)[differ], low[differ])
            while True:
                q = p[p]
                if np.array_equal(q, p):
                    break
                p[:] = q


def sketch(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, tkey, cls, n, bands, sig) of each row: cls stands for its set of shingles, bands and sig for its MinHash values."""
    multipliers = common.odd_constants(BANDS * ROWS, 0xA5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = common.WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                out: list[tuple] = []
                for t in part.column(2).to_pylist():
                    shingles = np.unique(common.word_shingles(t.split(), SIZE, hashes))
                    cls = xxhash.xxh3_64_intdigest(shingles.tobytes()) >> 1
                    low = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
                    with np.errstate(over="ignore"):
                        for i in range(0, len(shingles), 512):
                            np.minimum(low, (multipliers[:, None] * shingles[None, i : i + 512]).min(axis=1), out=low)
                        sig = (low >> np.uint64(32)).astype(np.uint32)
                        band = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                        for r in range(ROWS):
                            band = common.mix64(band ^ sig[r::ROWS].astype(np.uint64))
                    out.append((cls, len(shingles), common.signed(band).tolist() if len(shingles) else [], sig.tobytes()))
                cols = [part.column(0), part.column(1), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary()], strict=True))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc", "tkey", "cls", "n", "bands", "sig"])
        common.trim()

    return keyed(docs, key, text).mapInArrow(run, "doc long, tkey long, cls long, n int, bands array<long>, sig binary")


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, tkey, text): a row is known by its id and a hash of its text."""
    words = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).cast("long").alias("doc"), F.xxhash64(words).alias("tkey"), words.alias("text"))


def _cells(members: DataFrame, size: str, cell: int) -> DataFrame:
    """Rows (g, i, j, block) for pairs of blocks: a group of up to ``cell`` members is one cell, a larger one is
    cut into blocks by hash, and each two blocks are a cell of their own, wherever they run."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col(size) / cell)).cast("int")
    rows = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("cls", F.lit(7)), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    spread = rows.select("*", other)
    return spread.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "blocks")


def _groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[dict[str, list]]:
    """Rows of equal (group, i, j), which follow each other, as lists."""
    held: dict[str, list] | None = None
    key = None
    for batch in batches:
        got = {c: batch.column(c).to_pylist() for c in ("g", "i", "j", *columns)}
        keys = list(zip(got["g"], got["i"], got["j"], strict=True))
        at = 0
        while at < len(keys):
            end = at + 1
            while end < len(keys) and keys[end] == keys[at]:
                end += 1
            if keys[at] != key:
                if held is not None:
                    yield held
                held, key = {c: [] for c in ("g", "i", "j", *columns)}, keys[at]
            for c in held:
                held[c] += got[c][at:end]
            at = end
    if held is not None:
        yield held


def _placed(cells: DataFrame) -> DataFrame:
    return cells.repartition(common.parts(cells.sparkSession), "g", "i", "j").sortWithinPartitions("g", "i", "j", "cls")


def _pairs(block: np.ndarray, i: int, j: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that this cell is to compare, in batches: within block i if i == j, else between the two."""
    if i == j:
        rows = np.flatnonzero(block == i)
        for k in range(len(rows)):
            yield np.full(len(rows) - k - 1, rows[k]), rows[k + 1 :]
    else:
        a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
        for x in a:
            yield np.full(len(b), x), b


def candidate_links(sketches: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """Links (a, b) that join the classes of each bucket whose pairs survive the pruning; one per class and bucket at most."""
    spark = sketches.sparkSession
    classes = sketches.where("n > 0").groupBy("cls").agg(F.first("bands").alias("bands"))
    entries = classes.select("cls", F.posexplode("bands").alias("band", "g")).drop("band")
    # Buckets of one class need no more; buckets with the same members need one comparison.
    buckets = entries.groupBy("g").agg(F.count(F.lit(1)).alias("members"), F.sum(F.xxhash64("cls").cast("decimal(38,0)")).alias("s1"), F.bit_xor(F.xxhash64("cls", F.lit(3))).alias("s2")).where("members > 1")
    chosen = buckets.groupBy("members", "s1", "s2").agg(F.min("g").alias("g")).select("g", "members")
    members = entries.join(chosen, "g").distinct()
    signed = members.join(sketches.groupBy("cls").agg(F.min("sig").alias("sig")), "cls")
    needed = least_matches(threshold, tolerance, BANDS * ROWS, STEP)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for cell in _groups(batches, ["cls", "block", "sig"]):
            cls = np.array(cell["cls"], np.int64)
            signatures = np.frombuffer(b"".join(cell["sig"]), np.uint32).reshape(len(cls), -1)
            union = Union(len(cls))
            left, right, n = [], [], 0
            for a, b in _pairs(np.array(cell["block"]), cell["i"][0], cell["j"][0]):
                left.append(a)
                right.append(b)
                n += len(a)
                if n > 200_000:
                    _join(union, signatures, left, right, needed)
                    left, right, n = [], [], 0
            _join(union, signatures, left, right, needed)
            roots = union.parent
            out += [(int(cls[roots[k]]), int(cls[k])) for k in np.flatnonzero(roots != np.arange(len(cls)))]
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    cells = _cells(signed, "members", SIGNATURE_CELL).select("g", "i", "j", "cls", "block", "sig")
    return _placed(cells).mapInArrow(compare, "a long, b long")


def _join(union: Union, signatures: np.ndarray, left: list[np.ndarray], right: list[np.ndarray], needed: np.ndarray) -> None:
    if left:
        a, b = np.concatenate(left), np.concatenate(right)
        stay = surviving_pairs(signatures, a, b, needed, STEP)
        union.add(a[stay], b[stay])


def exact_links(docs: DataFrame, sketches: DataFrame, blocks: DataFrame, key: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (a, b, links): class a has so many linked documents in a cell; b is the least class of its group there.

    Within a block every two classes are compared by the sizes of the intersection and union of their shingle sets.
    """
    weights = sketches.groupBy("cls").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc", "tkey")).alias("one"))
    sizes = blocks.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    wanted = blocks.join(sizes, "component").join(weights.withColumnRenamed("cls", "id"), "id").select(F.col("id").alias("cls"), F.col("component").alias("g"), "members", "copies", "one.doc", "one.tkey")
    texts = _texts(docs, wanted, key, text)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = common.WordHashes()
        out: list[tuple[int, int, int]] = []
        for cell in _groups(batches, ["cls", "block", "copies", "text"]):
            cls, copies, block = np.array(cell["cls"], np.int64), np.array(cell["copies"], np.int64), np.array(cell["block"])
            first = np.concatenate(([True], cls[1:] != cls[:-1]))  # a repeated row may have come twice
            at = np.flatnonzero(first)
            cls, copies, block = cls[at], copies[at], block[at]
            sets = [np.unique(common.word_shingles(cell["text"][k].split(), SIZE, hashes)) for k in at]
            union, links = Union(len(cls)), np.zeros(len(cls), np.int64)
            i, j = cell["i"][0], cell["j"][0]
            for a, b in similar_pairs(sets, np.flatnonzero(block == i), np.flatnonzero(block == j), threshold):
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                union.add(a, b)
            roots = union.parent
            out += [(int(cls[k]), int(cls[roots[k]]), int(links[k])) for k in np.flatnonzero(links)]
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b", "links"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b", "links"])
        common.trim()

    cells = _cells(texts, "members", CELL).select("g", "i", "j", "cls", "block", "copies", "text")
    return _placed(cells).mapInArrow(verify, "a long, b long, links long")


def _texts(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    rows = keyed(docs, key, text)
    same = rows["doc"].eqNullSafe(wanted["doc"]) & (rows["tkey"] == wanted["tkey"])
    return rows.join(wanted, same).select(wanted["g"], wanted["members"], wanted["cls"], wanted["copies"], rows["text"])


def similar_pairs(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs, one from a and one from b (each once if they are the same rows), with a Jaccard similarity of the threshold."""
    same = len(a) == len(b) and np.array_equal(a, b)
    if same and len(a) == 2:
        x, y = sets[a[0]], sets[a[1]]
        both = len(np.intersect1d(x, y, assume_unique=True))
        if both >= threshold * (len(x) + len(y) - both) - 1e-9:
            yield a[:1], a[1:]
        return
    used = np.unique(np.concatenate([a, b]))
    sizes = np.zeros(len(sets))
    sizes[used] = [len(sets[k]) for k in used]
    values, column = np.unique(np.concatenate([sets[k] for k in used]), return_inverse=True)
    row = np.repeat(np.arange(len(used)), [len(sets[k]) for k in used])
    at = np.zeros(len(sets), np.int64)
    at[used] = np.arange(len(used))
    shared = np.zeros((len(a), len(b)), np.float32)
    for low in range(0, len(values), 4096):
        part = (column >= low) & (column < low + 4096)
        dense = np.zeros((len(used), min(4096, len(values) - low)), np.float32)
        dense[row[part], column[part] - low] = 1
        shared += dense[at[a]] @ dense[at[b]].T
    close = shared >= threshold * (sizes[a][:, None] + sizes[b][None, :] - shared) - 1e-6
    if same:
        close = np.triu(close, 1)
    x, y = np.nonzero(close)
    if len(x):
        yield a[x], b[y]


def jaccard_join(docs: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """A row for each row of docs: doc_id, tkey, class_id, n_links, first.

    class_id is the least id of the documents that links connect, n_links the number of other
    documents whose shingle sets have a Jaccard similarity of ``threshold`` or more, copies
    included; ``first`` marks one row of each class. Shingles are windows of five words; a
    shorter text is one shingle, and null, empty and blank texts are copies of each other.
    Repeated rows are copies too. Null ids come before others. Very long texts count whole, their
    shingles are hashed some at a time. An empty table gives no rows. Other columns are not used.
    """
    sketches = common.stored(sketch(docs, key, text), "sketches")
    blocks = components(candidate_links(sketches, threshold))
    verified = common.stored(exact_links(docs, sketches, blocks, key, text, threshold), "verified")
    counts = verified.groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    groups = components(verified.select("a", "b")).withColumnRenamed("id", "cls")
    per_class = sketches.groupBy("cls").agg(F.count(F.lit(1)).alias("copies"), F.min("doc").alias("least"), F.min(F.struct("doc", "tkey")).alias("one"))
    joined = common.stored(
        per_class.join(counts, "cls", "left").join(groups, "cls", "left")
        .select("cls", "copies", "least", "one", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "cls").alias("component")), "classes",
    )
    named = joined.groupBy("component").agg(F.min("least").alias("class_id"), F.min("one").alias("one"))
    final = joined.drop("one").join(named, "component").select("cls", "class_id", "one", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    first = F.col("doc").eqNullSafe(F.col("one.doc")) & (F.col("tkey") == F.col("one.tkey"))
    return sketches.select("doc", "tkey", "cls").join(final, "cls").select(F.col("doc").alias("doc_id"), "tkey", "class_id", "n_links", first.alias("first"))


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, unchanged, with one row of each class: the least by id, then by hash of the text."""
    own, rank = "_rasterloom_tkey", "_rasterloom_rank"  # a column of docs could be called tkey
    first = jaccard_join(docs, key=key, text=text, threshold=threshold).where("first").select("doc_id", "tkey")
    rows = docs.withColumn(own, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    same = rows[key].cast("long").eqNullSafe(first["doc_id"]) & (rows[own] == first["tkey"])
    kept = rows.join(first, same, "left_semi")
    once = W.partitionBy(F.col(key), F.col(own)).orderBy(F.lit(1))  # rows that are repeated as they are
    return kept.withColumn(rank, F.row_number().over(once)).where(F.col(rank) == 1).drop(own, rank)
