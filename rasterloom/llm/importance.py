"""Importance resampling towards a target distribution, over bucket-partitioned inverted postings.

A feature is a run of one to three consecutive words; its bucket is the CRC-32 of its bytes
modulo ``buckets``. Texts become postings (bucket, document, count), packed in blocks of one
chunk of documents and one range of buckets and shuffled by both: a chunk holds at most
``CHUNK_DOCS`` documents and about ``CHUNK_WORDS`` words, so a bucket that every document has is
many blocks in many tasks. Blocks of both corpora are added up per bucket, a bucket's gain comes from the
two sums, each block turns its counts into contributions, one per document, and these
are reduced by document: as many rows as there are ranges, whatever a document's length.

Nulls: a null text has no words; a null id counts as the empty string in the draw and sorts first.
Empty texts: no features, weight 0. Very long texts: read in slices of ``SLICE`` bytes, with two
words carried over. Ties: equal scores go to the smaller id. Repeated rows: each is a document
of its own. Empty tables: no rows; an empty target leaves only the prior. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.llm import common

#: Ranges of buckets; a document's contributions arrive in as many rows at most.
RANGES = 16
#: Documents of a chunk: their numbers fit a byte.
CHUNK_DOCS = 256
CHUNK_WORDS = 250_000
#: Bytes of a text that are cut into words at once.
SLICE = 1 << 22
#: Longest word, with the space before it, that goes through the tables of ``_zeros``; longer ones go through zlib.
LONGEST = 64

#: A-Z become a-z, bytes that are no part of a word become spaces: all ASCII but digits and letters.
_WORD_BYTES = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def words_of(text: str) -> Iterator[list[bytes]]:
    """The words of a text, some at a time."""
    data = text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES)
    at = 0
    while at < len(data):
        end = at + SLICE
        if end < len(data):
            cut = data.rfind(b" ", at, end)
            cut = data.find(b" ", end) if cut < 0 else cut
            end = len(data) if cut < 0 else cut
        yield data[at:end].split()
        at = end + 1


def _zeros(longest: int) -> np.ndarray:
    """Flat tables: entry [n, k, b] is the CRC register after n zero bytes that held byte b at place k."""
    one = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)  # linear part of a step
    now = np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32)[:, None] * np.uint32(8))
    out = np.empty((longest + 1, 4, 256), np.uint32)
    for n in range(longest + 1):
        out[n] = now
        now = (now >> np.uint32(8)) ^ one[now & np.uint32(255)]
    return out.ravel()


class Words:
    """What each word adds to a CRC: its own, that with a space before it, and how far it moves what came before."""

    def __init__(self, limit: int = 200_000):
        self.limit, self.zeros = limit, _zeros(LONGEST)
        self._reset()

    def _reset(self) -> None:
        self.number: dict[bytes, int] = {}
        self.alone, self.spaced, self.moves, self.text = [], [], [], []

    def codes(self, words: Sequence[bytes]) -> list[int]:
        number = self.number
        out = []
        for w in words:
            n = number.get(w)
            if n is None:
                n = number[w] = len(self.text)
                self.text.append(w if len(w) >= LONGEST else b"")
                self.alone.append(zlib.crc32(w))
                self.spaced.append(zlib.crc32(b" " + w))
                self.moves.append(len(w) + 1)
            out.append(n)
        return out

    def after(self, crc: np.ndarray, codes: np.ndarray, spaced: np.ndarray, moves: np.ndarray) -> np.ndarray:
        """CRCs of what ``crc`` stands for, a space and the word of each code."""
        n, z = moves[codes], self.zeros
        far = n > LONGEST
        at = np.where(far, 0, n) * 1024
        out = z[at + (crc & 255)] ^ z[at + 256 + ((crc >> 8) & 255)] ^ z[at + 512 + ((crc >> 16) & 255)] ^ z[at + 768 + (crc >> 24)] ^ spaced[codes]
        for i in np.flatnonzero(far):
            out[i] = zlib.crc32(b" " + self.text[codes[i]], int(crc[i]))
        return out

    def features(self, codes: np.ndarray, group: np.ndarray, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(CRC, group) of the runs of one to three words within a group that end at a counted word."""
        alone, spaced, moves = np.array(self.alone, np.uint32), np.array(self.spaced, np.uint32), np.array(self.moves, np.int64)
        one = alone[codes]
        two_at = np.flatnonzero(group[1:] == group[:-1]) + 1
        two = np.zeros_like(one)
        two[two_at] = self.after(one[two_at - 1], codes[two_at], spaced, moves)
        three_at = np.flatnonzero(group[2:] == group[:-2]) + 2
        three = self.after(two[three_at - 1], codes[three_at], spaced, moves)
        two_at, keep = two_at[counted[two_at]], counted[three_at]
        crc = np.concatenate([one[counted], two[two_at], three[keep]])
        return crc, np.concatenate([group[counted], group[two_at], group[three_at[keep]]])

    def forget(self) -> None:
        if len(self.text) > self.limit:
            self._reset()


class _Chunk:
    """Documents that wait to be written as blocks of postings."""

    def __init__(self, words: Words, buckets: int):
        self.words, self.buckets, self.counts = words, buckets, np.zeros(buckets * CHUNK_DOCS, np.int64)
        self.clear()

    def clear(self) -> None:
        self.ids, self.n_words, self.pending = [], [], 0
        self.codes, self.docs, self.counted = [], [], []
        self.counts[:] = 0

    def add(self, key: object, text: str | None) -> None:
        doc, n, carried = len(self.ids), 0, []
        for words in words_of(text or ""):
            run = carried + words
            self.codes.append(np.array(self.words.codes(run), np.int64))
            self.docs.append(doc)
            self.counted.append(np.arange(len(run)) >= len(carried))
            n, self.pending, carried = n + len(words), self.pending + len(words), run[-2:]
            if self.pending >= CHUNK_WORDS:
                self._count()
        self.ids.append(key)
        self.n_words.append(n)

    def _count(self) -> None:
        """Add the pending words' features; a carried word is a run's beginning only, and slices are kept apart."""
        if not self.codes:
            return
        codes, counted = np.concatenate(self.codes), np.concatenate(self.counted)
        piece = np.repeat(np.arange(len(self.codes)), [len(c) for c in self.codes])
        crc, piece = self.words.features(codes, piece, counted)
        self.counts += np.bincount(crc.astype(np.int64) % self.buckets * CHUNK_DOCS + np.array(self.docs)[piece], minlength=len(self.counts))
        self.codes, self.docs, self.counted, self.pending = [], [], [], 0
        self.words.forget()

    @property
    def full(self) -> bool:
        return len(self.ids) >= CHUNK_DOCS or self.pending >= CHUNK_WORDS

    def rows(self, chunk: int) -> Iterator[dict]:
        """The list of documents (range -1) and a block per range of buckets."""
        self._count()
        at = np.flatnonzero(self.counts)
        n = self.counts[at]
        per_doc = np.bincount(at % CHUNK_DOCS, n, CHUNK_DOCS).astype(np.int64)[: len(self.ids)]
        yield {"chunk": chunk, "range": -1, "ids": self.ids, "n_words": self.n_words, "n_features": per_doc.tolist(), "lengths": None, "docs": None, "counts": None, "more": None}
        width = -(-self.buckets // RANGES)
        cuts = np.searchsorted(at, np.arange(RANGES + 1) * width * CHUNK_DOCS)
        for r in range(RANGES):
            a, c = at[cuts[r] : cuts[r + 1]], n[cuts[r] : cuts[r + 1]]
            if len(a):
                big = np.flatnonzero(c > 255)
                yield {
                    "chunk": chunk, "range": r, "ids": None, "n_words": None, "n_features": None,
                    "lengths": np.bincount(a // CHUNK_DOCS - r * width, minlength=width).astype("<u2").tobytes(), "docs": (a % CHUNK_DOCS).astype(np.uint8).tobytes(),
                    "counts": np.minimum(c, 255).astype(np.uint8).tobytes(), "more": np.concatenate([big, c[big]]).astype("<i8").tobytes(),
                }
        self.clear()


def unpack(lengths: bytes, docs: bytes, counts: bytes, more: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's (bucket within the range, document within the chunk, count)."""
    n = np.frombuffer(lengths, "<u2")
    count = np.frombuffer(counts, np.uint8).astype(np.int64)
    big = np.frombuffer(more, "<i8")
    count[big[: len(big) // 2]] = big[len(big) // 2 :]
    return np.repeat(np.arange(len(n)), n), np.frombuffer(docs, np.uint8).astype(np.int64), count


def postings(df: DataFrame, key: str | None, text: str = "text", buckets: int = 10_000) -> DataFrame:
    """Blocks of postings of each text and, as range -1, the list of each chunk's documents."""
    rows = df.select((F.col(key) if key else F.lit(None).cast("long")).alias("key"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([
        T.StructField("chunk", T.LongType()), T.StructField("range", T.IntegerType()), T.StructField("ids", T.ArrayType(rows.schema["key"].dataType)),
        T.StructField("n_words", T.ArrayType(T.LongType())), T.StructField("n_features", T.ArrayType(T.LongType())), *(T.StructField(c, T.BinaryType()) for c in ("lengths", "docs", "counts", "more")),
    ])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, number = _Chunk(Words(), buckets), TaskContext.get().partitionId() << 33
        types = None
        for b in batches:
            if types is None:
                ids = pa.list_(b.schema.field("key").type)
                types = pa.schema([("chunk", pa.int64()), ("range", pa.int32()), ("ids", ids), ("n_words", pa.list_(pa.int64())), ("n_features", pa.list_(pa.int64()))] + [(c, pa.binary()) for c in ("lengths", "docs", "counts", "more")])
            for i in range(b.num_rows):
                chunk.add(b.column(0)[i].as_py(), b.column(1)[i].as_py())
                if chunk.full:
                    yield pa.RecordBatch.from_pylist(list(chunk.rows(number)), types)
                    number += 1
        if chunk.ids:
            yield pa.RecordBatch.from_pylist(list(chunk.rows(number)), types)
        common.trim()

    return rows.mapInArrow(pack, schema)


def _totals(blocks: DataFrame, name: str, buckets: int) -> DataFrame:
    """(bucket, count), added up within each task before the shuffle."""
    width = -(-buckets // RANGES)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((RANGES, width))  # exact up to 2^53
        for b in batches:
            for row in b.to_pylist():
                bucket, _, count = unpack(row["lengths"], row["docs"], row["counts"], row["more"])
                sums[row["range"]] += np.bincount(bucket, count, width)
        flat = sums.ravel()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int32()), "n": pa.array(flat[at].astype(np.int64))})

    got = blocks.where("range >= 0").select("range", "lengths", "docs", "counts", "more").mapInArrow(add, "bucket int, n long")
    return got.groupBy("bucket").agg(F.sum("n").alias(name))


def bucket_gains(raw: DataFrame, target: DataFrame, buckets: int = 10_000) -> DataFrame:
    """(bucket, s, t, gain) of the two corpora's blocks; a gain is 1000 times the logarithm of the smoothed ratio of shares, floored."""
    both = common.stored(_totals(raw, "s", buckets).join(_totals(target, "t", buckets), "bucket", "full").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")), "importance-totals")
    size = both.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    ratio = (F.col("t") + 1.0) * F.lit(float(size[0] + buckets)) / ((F.col("s") + 1.0) * F.lit(float(size[1] + buckets)))
    return both.withColumn("gain", F.floor(1000 * F.log(ratio)).cast("long"))


def weights(documents: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = 10_000) -> DataFrame:
    """(key, n_words, n_features, weight, chunk, place) of every document; chunk and place tell repeated rows apart."""
    spark, width = documents.sparkSession, -(-buckets // RANGES)
    blocks = postings(documents, key, text, buckets)
    blocks = common.stored(blocks.repartition(common.parts(spark), "range", "chunk"), "importance-postings")
    gains = bucket_gains(blocks, postings(target, None, text, buckets), buckets)
    # RANGES rows of at most ``width`` numbers, whatever the corpora hold.
    few = gains.groupBy(F.floor(F.col("bucket") / width).cast("int").alias("range")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("bucket") % width).alias("b"), "gain"))).alias("gains"))
    few = few.select("range", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda b: F.coalesce(F.element_at("gains", b), F.lit(0).cast("long"))).alias("gains"))

    def contribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chunk, place, part = [], [], []
            for row in b.to_pylist():
                bucket, doc, count = unpack(row["lengths"], row["docs"], row["counts"], row["more"])
                order = np.argsort(doc, kind="stable")
                first = np.flatnonzero(np.r_[True, np.diff(doc[order]) > 0])
                place.append(doc[order][first])
                part.append(np.add.reduceat((np.array(row["gains"], np.int64)[bucket] * count)[order], first))
                chunk.append(np.full(len(first), row["chunk"]))
            if chunk:
                yield pa.RecordBatch.from_pydict({"chunk": np.concatenate(chunk), "place": pa.array(np.concatenate(place), pa.int32()), "part": np.concatenate(part)})

    parts = blocks.where("range >= 0").join(F.broadcast(few), "range").select("chunk", "lengths", "docs", "counts", "more", "gains").mapInArrow(contribute, "chunk long, place int, part long")
    listed = blocks.where("range = -1").select("chunk", F.posexplode(F.arrays_zip("ids", "n_words", "n_features")).alias("place", "d"))
    listed = listed.select("chunk", "place", F.lit(0).cast("long").alias("part"), F.struct(F.col("d.ids").alias("key"), F.col("d.n_words").alias("n_words"), F.col("d.n_features").alias("n_features")).alias("d"))
    whole = listed.unionByName(parts, allowMissingColumns=True).groupBy("chunk", "place").agg(F.first("d", ignorenulls=True).alias("d"), F.sum("part").alias("weight"))
    return whole.select(F.col("d.key").alias(key), F.col("d.n_words").alias("n_words"), F.col("d.n_features").alias("n_features"), "weight", "chunk", "place")


def gumbel(key: Column, seed: int) -> Column:
    """1000 times a standard Gumbel value that the seed and the key's text give, floored."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(documents: DataFrame, target: DataFrame, *, share: tuple[int, int] = (5, 100), least_words: int = 20, seed: int = 42, key: str = "doc_id", text: str = "text", buckets: int = 10_000) -> DataFrame:
    """(key, n_features, weight, score, rank) of every document.

    ``share`` of the documents of at least ``least_words`` words are drawn without replacement: those of
    the highest weight plus Gumbel value. Ranks come from a range partitioning by score and each range's count.
    """
    spark = documents.sparkSession
    scored = common.stored(weights(documents, target, key, text, buckets).withColumn("score", F.col("weight") + gumbel(F.col(key), seed)), "importance-scores")
    n = scored.where(F.col("n_words") >= least_words).count()
    drawn = n * share[0] // share[1]
    order = [F.col("score").desc(), F.col(key).asc_nulls_first(), F.col("chunk"), F.col("place")]
    ranged = scored.where(F.col("n_words") >= least_words).repartitionByRange(common.parts(spark), *order).sortWithinPartitions(*order)
    ranged = common.stored(ranged.select(key, "n_features", "weight", "score", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("i")), "importance-order")
    before, at = [], 0
    for p, count in ranged.groupBy("p").count().orderBy("p").collect():  # one row a partition
        before.append((p, at))
        at += count
    offsets = spark.createDataFrame(before, "p int, before long")
    place = F.col("before") + F.col("i") + 1
    ranked = ranged.join(F.broadcast(offsets), "p").select(key, "n_features", "weight", "score", F.when(place <= drawn, place).alias("rank"))
    return ranked.unionByName(scored.where(F.col("n_words") < least_words).select(key, "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))
