"""Document fingerprints by consistent weighted sampling.

Terms are windows of five words, weighted by their number in the text. For each
of k samples a term S of weight w has r, c ~ Gamma(2, 1) and b ~ U(0, 1), and

    t = floor(ln w / r + b),   ln a = ln c - r (t - b) - r,

and the term of least a is sampled, together with t. Two texts draw the same
(term, t) with a probability equal to the generalised Jaccard similarity of
their weights. The variates come from a fixed pool of 2**18 triples; the leading bits
of a hash of (term, sample) pick the triple, the others settle equal values. The
pool is sorted by the ln a of weight 1, so among terms of weight 1 the least
hash has the least a.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm import common

POOL_BITS = 18
SIZE = 5
SAMPLES = 128


@functools.cache
def _pool() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """r, ln c, b and the ln a of weight 1, each of 2**18 values from counted uniform numbers."""
    n = 1 << POOL_BITS
    with np.errstate(over="ignore"):
        u = [(common.mix64(np.arange(n, dtype=np.uint64) + np.uint64((j + 1) << 40)) >> np.uint64(11)).astype(np.float64) / 2**53 + 2**-54 for j in range(5)]
    r, c, b = -np.log(u[0] * u[1]), -np.log(u[2] * u[3]), u[4]
    order = np.argsort(np.log(c) - r * (1 - b))
    r, ln_c, b = r[order], np.log(c)[order], b[order]
    return r, ln_c, b, ln_c - r * (1 - b)


@functools.cache
def _multipliers(samples: int) -> np.ndarray:
    return common.odd_constants(samples, 0x51ED27)


def sample_terms(terms: np.ndarray, weights: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """32-bit values of the sampled (term, t), one for each sample; terms are distinct 64-bit hashes."""
    r, ln_c, b, ones = _pool()
    a = _multipliers(samples)
    out = np.zeros(samples, np.uint32)
    if not len(terms):
        return out
    best = np.full(samples, np.inf)
    chosen = np.full(samples, 2**64 - 1, np.uint64)
    step = np.zeros(samples, np.int64)
    shift = np.uint64(64 - POOL_BITS)
    heavy = weights != 1
    with np.errstate(over="ignore"):
        light = terms[~heavy]
        for i in range(0, len(light), 512):
            np.minimum(chosen, (a[:, None] * light[None, i : i + 512]).min(axis=1), out=chosen)
        if len(light):
            best = ones[(chosen >> shift).astype(np.int64)]
        terms, weights = terms[heavy], weights[heavy]
        for i in range(0, len(terms), 512):
            h = a[:, None] * terms[None, i : i + 512]
            pick = (h >> shift).astype(np.int64)
            t = np.floor(np.log(weights[i : i + 512].astype(np.float64)) / r[pick] + b[pick])
            value = ln_c[pick] - r[pick] * (t - b[pick]) - r[pick]
            low = value.min(axis=1)
            hash_at = np.where(value == low[:, None], h, np.uint64(2**64 - 1)).min(axis=1)
            t_at = t[np.arange(samples), (h == hash_at[:, None]).argmax(axis=1)].astype(np.int64)
            better = (low < best) | ((low == best) & (hash_at < chosen))
            best[better], chosen[better], step[better] = low[better], hash_at[better], t_at[better]
        return (common.mix64(chosen ^ (step.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(32)).astype(np.uint32)


def fingerprint_values(text: str, hashes: common.WordHashes, size: int = SIZE, samples: int = SAMPLES) -> np.ndarray:
    """The 32-bit samples of a text; none for a text without words."""
    shingles = common.word_shingles(text.split(), size, hashes)
    if not len(shingles):
        return np.empty(0, np.uint32)
    terms, weights = np.unique(shingles, return_counts=True)
    return sample_terms(terms, weights, samples)


def fingerprint_text(values: np.ndarray) -> str:
    """Base64 of the little-endian samples; '' for a text without words."""
    return base64.b64encode(values.astype("<u4").tobytes()).decode()


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """Share of equal samples; two texts without words are alike, one of them is unlike any other."""
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    return float((x == y).mean())


def edited_text(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of another text, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (target, borrowed, key, text) placed so that a target's rows are in one partition, in order.

    Targets are consecutive ranges of keys. A row that begins a range is also sent, as
    borrowed, to the range before it, so each row's follower is at hand with one shuffle.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("order", F.coalesce(F.col("key"), F.lit(common.NULL_ID)))
    bounds = common.range_bounds(rows, "key", common.parts(spark))
    ranged = rows.withColumn("own", common.range_of(F.col("order"), bounds))
    # One row for each range, whatever the corpus.
    firsts = {r["own"]: r["first"] for r in ranged.groupBy("own").agg(F.min("order").alias("first")).collect()}
    used = sorted(firsts)
    before = {b: used[i - 1] for i, b in enumerate(used)}
    n = len(bounds) + 1
    first_of = F.element_at(F.array(*[F.lit(firsts.get(b)).cast("long") for b in range(n)]), F.col("own") + 1)
    before_of = F.element_at(F.array(*[F.lit(before.get(b, 0)) for b in range(n)]), F.col("own") + 1)
    here = F.struct(F.col("own").alias("target"), F.lit(False).alias("borrowed"))
    there = F.struct(before_of.alias("target"), F.lit(True).alias("borrowed"))
    sent = ranged.select(F.explode(F.when(F.col("order") == first_of, F.array(here, there)).otherwise(F.array(here))).alias("to"), "key", "order", "text")
    placed = sent.select("to.target", "to.borrowed", "key", "order", "text").repartitionById(n, F.col("target"))
    return placed.sortWithinPartitions("target", "borrowed", "order", "text").select("target", "borrowed", "key", "text")


def fingerprint_edits(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = SIZE, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of each text and of its edited text, with their likenesses.

    Null texts are empty. The next document is the next row by (key, text), null keys
    first; the last row's is the first row. Repeated rows follow each other. Very long texts are fingerprinted
    whole, their terms some at a time. An empty table gives no rows; other columns are not used.
    """
    import hashlib

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = common.WordHashes()
        held: tuple[int, int | None, str, np.ndarray] | None = None  # target, key, text, samples
        for batch in batches:
            out: list[tuple] = []
            for target, borrowed, k, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if borrowed and (held is None or held[0] != target):
                    continue  # a later borrowed row of the same key
                own = fingerprint_values(t, hashes, size, samples)
                if held is not None and held[0] == target:
                    edited = edited_text(held[2], t)
                    near = fingerprint_values(edited, hashes, size, samples)
                    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((held[1], len(held[2]), sha, fingerprint_text(held[3]), fingerprint_text(near), likeness(held[3], near), likeness(held[3], own)))
                held = None if borrowed else (target, k, t, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), types, strict=True)], names=names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, key, text).mapInArrow(run, schema)
