"""Toxicity from class-conditional Kneser-Ney models of characters.

Words are spelt ``^word$``. A toxic and an ordinary model give the probability
of each character after the up to four before it in its word. Each model
discounts its own counts and backs off to one shared Kneser-Ney model, whose
lower orders use continuation counts over all documents, so an expression that
is rare in both classes adds nothing. A toxic text is for the most part made of
ordinary words: each of its words is toxic with the probability SHARE, and its
likelihood is that of the likeliest choice of the toxic ones, the product of
max((1 - SHARE) P(word | ordinary), SHARE P(word | toxic)); that of an ordinary text is
the product of P(word | ordinary). The logarithms of both are divided by the
number of words and compared; a logistic curve fitted on labelled rows that the
models have not seen turns the difference into a score.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm import common

ORDER = 5
#: Labelled rows that the class models are fitted on, and further ones for the logistic curve, at most.
MODEL_ROWS = 20_000
CURVE_ROWS = 4_000
DISCOUNT = 0.75
#: The share of toxic words that a toxic text is taken to have.
SHARE = 0.05
#: The difference of the length-normalised log-likelihoods is at least ln(1 - SHARE); the curve takes ln(1 + what it has above that / SCALE).
SCALE = 0.01


def spelt(word: str) -> str:
    return f"^{word}$"


def grams(word: str, order: int = ORDER) -> list[str]:
    """For each character after the first, itself with the up to order - 1 before it."""
    s = spelt(word)
    return [s[max(0, i - order + 1) : i + 1] for i in range(1, len(s))]


def count_grams(words: Counter, order: int = ORDER) -> Counter:
    out: Counter = Counter()
    get = out.get
    for word, n in words.items():
        s = f"^{word}$"
        for i in range(1, len(s)):
            g = s[i - order + 1 : i + 1] if i >= order else s[: i + 1]
            out[g] = get(g, 0) + n
    return out


@dataclass
class Model:
    """ln P(toxic) - ln P(ordinary) of grams that a class has, and of other grams by their context."""

    seen: dict[str, float]
    backoff: dict[str, float]
    slope: float = 1.0
    centre: float = 0.0

    def word(self, word: str) -> float:
        seen, backoff, s, total = self.seen, self.backoff, f"^{word}$", 0.0
        for i in range(1, len(s)):
            g = s[i - ORDER + 1 : i + 1] if i >= ORDER else s[: i + 1]
            value = seen.get(g)
            total += backoff.get(g[:-1], 0.0) if value is None else value
        return total

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.slope * (evidence - self.centre)))))


LOG_ODDS = math.log(SHARE / (1 - SHARE))


def word_evidence(ratio: float) -> float:
    """ln P(word | toxic text) - ln P(word | ordinary text), less its lowest value ln(1 - SHARE), for a word of this ln P(word | toxic) - ln P(word | ordinary)."""
    return max(0.0, ratio + LOG_ODDS)


class Evidence:
    """Length-normalised evidence of texts; the values of up to ``limit`` words are kept."""

    def __init__(self, model: Model, limit: int = 100_000):
        self.model, self.limit = model, limit
        self.known: dict[str, float] = {}

    def of(self, text: str) -> float:
        words = text.lower().split()
        if not words:
            return 0.0
        known = self.known
        try:
            return math.log1p(sum([known[w] for w in words]) / len(words) / SCALE)
        except KeyError:
            if len(known) > self.limit:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = word_evidence(self.model.word(w))
            return math.log1p(sum([known[w] for w in words]) / len(words) / SCALE)


def shared_model(table: DataFrame) -> DataFrame:
    """table with ``below``: the interpolated Kneser-Ney probability of each labelled gram's last character below
    its full order, i.e. after its context without the first character.

    n has the counts of the top grams over all documents. A level holds what the grams of the one above it end in,
    counted by kinds; every gram of every level takes part, and only rows of labelled documents come back.
    """
    rest, context = F.expr("substring(gram, 2)"), F.expr("substring(gram, 1, length(gram) - 1)")
    levels, sizes = [table.select("gram", "n")], [table.count()]
    for _ in range(ORDER - 1):
        lower = levels[-1].where(F.length("gram") > 1).groupBy(rest.alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        levels.append(common.stored(lower, "grams-lower"))
        sizes.append(levels[-1].count())
    flat = F.lit(1 / (1 + next((n for n in reversed(sizes) if n), 0)))
    below = None
    for level in reversed(levels[1:]):
        totals = level.groupBy(context.alias("context")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("types"))
        own = level.select("gram", "n", rest.alias("rest"), context.alias("context")).join(totals, "context")
        own = own.withColumn("below", flat) if below is None else own.join(below, "rest", "left").withColumn("below", F.coalesce("below", flat))
        p = F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) / F.col("total") + DISCOUNT * F.col("types") / F.col("total") * F.col("below")
        below = own.select(F.col("gram").alias("rest"), p.alias("below"))
    labelled = table.where("toxic > 0 OR ordinary > 0").withColumn("rest", rest)
    return labelled.join(below, "rest", "left").select("gram", F.coalesce("below", flat).alias("below"), "toxic", "ordinary")


def fit_model(rows: list[tuple[str, float, int, int]]) -> Model:
    """rows: (gram, its probability in the shared model, count in toxic documents, in ordinary ones)."""
    total, types = ({}, {}), ({}, {})
    for g, _, *own in rows:
        for c in (0, 1):
            if own[c]:
                total[c][g[:-1]] = total[c].get(g[:-1], 0) + own[c]
                types[c][g[:-1]] = types[c].get(g[:-1], 0) + 1
    weight = [{h: DISCOUNT * types[c][h] / n for h, n in total[c].items()} for c in (0, 1)]
    seen = {}
    for g, below, *own in rows:
        h, p = g[:-1], []
        for c in (0, 1):
            n = total[c].get(h)
            p.append(below if not n else max(own[c] - DISCOUNT, 0) / n + weight[c][h] * below)
        seen[g] = math.log(p[0]) - math.log(p[1])
    backoff = {h: math.log(weight[0].get(h, 1.0)) - math.log(weight[1].get(h, 1.0)) for h in {*total[0], *total[1]}}
    return Model(seen, backoff)


def fit_curve(model: Model, evidence: list[float], toxic: list[int]) -> None:
    """A logistic curve by Newton's method with a weak penalty; it stays steep and central where classes do not overlap."""
    x, y = np.array(evidence, float), np.array(toxic, float)
    if not len(x) or y.min() == y.max():
        spread = float(x.std()) if len(x) else 1.0
        model.slope, model.centre = 1 / max(spread, 1e-3), (float(x.max()) + 3 * spread if not len(y) or not y.any() else float(x.min()) - 3 * spread) if len(x) else 1.0
        return
    shift, scale = (x[y == 1].mean() + x[y == 0].mean()) / 2, max(x.std(), 1e-9)
    z = (x - shift) / scale
    w = np.zeros(2)
    design = np.stack([z, np.ones_like(z)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (p - y) + 1e-2 * w * [1, 0]
        hessian = (design * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ design + np.diag([1e-2, 1e-9])
        move = np.linalg.solve(hessian, gradient)
        w -= move * min(1.0, 2 / max(1e-12, np.abs(move).max()))
        if np.abs(move).max() < 1e-8:
            break
    model.slope, model.centre = float(w[0] / scale), float(shift - w[1] / w[0] * scale) if w[0] > 0 else float(shift)


def fold(key: Column) -> Column:
    """crc32 of the id as text, modulo 5; of a null id, of 'null'."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")) % 5


def _labelled(labels: DataFrame, key: str, toxic: str) -> DataFrame:
    """One row per labelled id outside the held-out fold; toxic if any of its rows says so."""
    rows = labels.where(F.col(key).isNotNull() & F.col(toxic).isNotNull() & (fold(F.col(key)) != 0))
    return rows.groupBy(F.col(key).cast("long").alias("key")).agg(F.max(F.col(toxic)).cast("int").alias("toxic"))


def _first(rows: DataFrame, n: int) -> DataFrame:
    """The n rows of least hash: a bounded sample that does not depend on the partitioning."""
    return rows.orderBy(F.xxhash64("key"), "key").limit(n)


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Model:
    """Fit on labelled rows outside the held-out fold: the class models on folds 1 to 3, the curve on fold 4.

    Class counts come from at most MODEL_ROWS labelled rows, the curve from at most CURVE_ROWS; the shared
    counts come from every document. No gram is too rare to count. The samples are small enough to broadcast by those bounds.
    """
    spark = docs.sparkSession
    labelled = _labelled(labels, key, toxic)
    sample = F.broadcast(_first(labelled.where(fold(F.col("key")) != 4), MODEL_ROWS))
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: tuple[Counter, Counter, Counter] = (Counter(), Counter(), Counter())

        def flush() -> Iterator[pa.RecordBatch]:
            found = [count_grams(w) for w in words]
            for w in words:
                w.clear()
            every = Counter(found[0])
            every.update(found[1])
            every.update(found[2])
            names = list(every)
            cols = [pa.array(names, pa.string()), *(pa.array([f[g] for g in names], pa.int64()) for f in (every, found[1], found[2]))]
            for at in range(0, len(names), 50_000):
                yield pa.RecordBatch.from_arrays([c.slice(at, 50_000) for c in cols], names=["gram", "n", "toxic", "ordinary"])

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for t, label in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words[0 if label is None else 1 if label else 2].update(t.lower().split())
                if sum(map(len, words)) > 200_000:
                    yield from flush()
        yield from flush()
        common.trim()

    counted = rows.join(sample, "key", "left").select("text", "toxic").mapInArrow(count, "gram string, n long, toxic long, ordinary long")
    table = common.stored(counted.groupBy("gram").agg(*(F.sum(c).alias(c) for c in ("n", "toxic", "ordinary"))), "grams")
    found = shared_model(table).toArrow()  # the grams of at most MODEL_ROWS documents
    model = fit_model(list(zip(*(found.column(c).to_pylist() for c in ("gram", "below", "toxic", "ordinary")), strict=True)) if found.num_rows else [])
    curve = F.broadcast(_first(labelled.where(fold(F.col("key")) == 4), CURVE_ROWS))
    shared = spark.sparkContext.broadcast(model)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = Evidence(shared.value)
        for batch in batches:
            found = [evidence.of(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64()), batch.column(1)], names=["evidence", "toxic"])

    points = rows.join(curve, "key").select("text", "toxic").mapInArrow(weigh, "evidence double, toxic int").toArrow()
    fit_curve(model, points.column("evidence").to_pylist(), points.column("toxic").to_pylist())
    return model


def score(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of each row.

    Null and empty texts have no evidence and score as such; repeated rows are scored each;
    a null id counts as the text 'null' for its fold; very long texts are read word by word, none is cut;
    an empty table gives no rows; other columns are not used.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = Evidence(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                keys = part.column(0).to_pylist()
                scores = [shared.value.score(evidence.of(t)) for t in part.column(1).to_pylist()]
                out = [keys, [zlib.crc32(("null" if k is None else str(k)).encode()) % 5 == 0 for k in keys], scores, [int(s >= 0.5) for s in scores]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["doc_id", "held_out", "score", "predicted"])

    types = [pa.int64(), pa.bool_(), pa.float64(), pa.int32()]
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """The rows of docs, unchanged, that score below 0.5."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = Evidence(shared.value)
        for batch in batches:
            keep = [shared.value.score(evidence.of(t or "")) < 0.5 for t in batch.column(text).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
