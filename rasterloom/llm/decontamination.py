"""Benchmark decontamination by templates with typed slots.

Numbers, names and units become placeholders, so a question whose parameters
were changed keeps its template. A leak is RUN consecutive tokens of an item's
template, or the whole of a shorter item, whose slots map one to one: the same
value in the item always meets the same value in the document, and the other
way round. That holds if and only if both windows have the same placeholders and
each slot repeats the value of the same earlier slot, or of none. So a window's
key is a hash of its template and another that adds, for each slot, how far back
its value was last seen in the window; equal keys are a consistent match, and
documents meet items in one equi join of keys.

Capitals tell names, so texts in other capitals than the item's are read in a
second way too, without name slots, and in a third, without slots, which finds
what is the same word for word. All three ignore case. A short item of few literal
tokens is read in a fourth way, with all slots, which only a whole sentence of a document matches.

A document's windows are not shuffled: only those whose first hash is set in a
bitmap of the benchmark's, which is of at most 2**BITMAP_BITS bits whatever the
benchmark, go on to the join. The items that have a window are its class. A document's hit counts for each of
them, so no item's coverage depends on another's, however many they are. A class of more than SHARED items has a
number besides, and ``members`` lists it.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm import common

#: Tokens of a leak.
RUN = 13
#: Items of fewer tokens are too short for templates; they are leaks only as they are.
LEAST = 5
#: A template's window needs a stretch of STRETCH tokens of which so many are no placeholders; without one it counts only word for word.
STRETCH, LITERAL = 8, 4
#: So many literal tokens are enough for a whole item, of less than RUN tokens, that is a sentence of its own in the document.
SENTENCE_LITERAL = 3
#: The number of the reading that meets whole sentences.
SENTENCE = 3
#: A class of more items has a number.
SHARED = 64
#: The bitmap that documents' windows are tested with has at most 2**BITMAP_BITS bits (16 MB).
BITMAP_BITS = 27
#: Tokens that are looked at together.
CHUNK = 100_000
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))

#: Words that are units after a number.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg gram grams kilogram kilograms t ton tons oz ounce ounces lb lbs pound pounds ml cl dl l liter liters litre litres gal gallon gallons "
    "s sec second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years dollar dollars cent cents euro euros usd eur percent degree degrees c f k kmh mph w kw v a hz khz mhz ghz b kb mb gb tb".split()
)
TOKENS = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?:;\n]+")
CAP, NUM, UNIT, END = 1, 2, 4, 8
CODES = {CAP: 0xA11CE, NUM: 0xB0B, UNIT: 0xCAFE}


class TokenKinds(dict):
    """token -> hash of it without case, the last four bits replaced by what it can be."""

    def __init__(self, limit: int = 300_000):
        self.limit = limit

    def __missing__(self, token: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        first = token[0]
        if first.isdigit():
            kind = NUM
        elif first.isalpha():
            kind = CAP * (first.isupper()) | UNIT * (token.lower() in UNITS)
        else:
            kind = END
        value = self[token] = (xxhash.xxh3_64_intdigest(token.casefold()) & ~15) | kind
        return value


class Readings:
    """Texts one after another, read in three ways: with all slots, without name slots, without any.

    codes[way] and slots[way] (kinds; 0: none) are of the template's tokens, back[way] how far before
    a slot its value last filled one; starts has each text's first token and, at the end, their number. A
    capitalised word is a name unless it begins a text or a sentence; a unit needs a number
    before it. Sentence ends are no tokens of the template.
    """

    def __init__(self, texts: list[list[str]], kinds: TokenKinds):
        words = [w for tokens in texts for w in (*tokens, ".")]  # a text's end is a sentence's
        raw = np.fromiter(map(kinds.__getitem__, words), np.uint64, len(words))
        flags = (raw & np.uint64(15)).astype(np.uint8)
        before = np.concatenate((np.array([END], np.uint8), flags[:-1])) if len(flags) else flags
        slot = np.where(flags & NUM, NUM, np.where((flags & UNIT > 0) & (before & NUM > 0), UNIT, np.where((flags & CAP > 0) & (before & END == 0), CAP, 0))).astype(np.uint8)
        keep = np.flatnonzero(flags & END == 0)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        self.starts = np.searchsorted(keep, np.concatenate(([0], ends)))
        plain, slot = raw[keep] >> np.uint64(4), slot[keep]
        unnamed = plain.copy()
        for kind in (NUM, UNIT):
            unnamed[slot == kind] = CODES[kind]
        codes = unnamed.copy()
        codes[slot == CAP] = CODES[CAP]
        self.plain = plain
        self.codes = [codes, unnamed, plain, codes]
        self.slots = [slot, np.where(slot == CAP, np.uint8(0), slot), np.zeros_like(slot), slot]
        end = flags & END > 0
        self.begins, self.closes = np.concatenate(([True], end[:-1]))[keep] if len(end) else end, np.concatenate((end[1:], [True]))[keep] if len(end) else end

    def back(self, way: int) -> np.ndarray:
        """How many tokens before each slot one of the same value was; 0: never."""
        out = np.zeros(len(self.plain), np.int64)
        places = np.flatnonzero(self.slots[way])
        if len(places):
            order = np.argsort(self.plain[places], kind="stable")
            places, values = places[order], self.plain[places][order]
            same = np.flatnonzero(values[1:] == values[:-1])
            out[places[same + 1]] = places[same + 1] - places[same]
        return out

    def first_hashes(self, way: int) -> RollingHashes:
        return RollingHashes(self.codes[way])

    def second_hashes(self, way: int, size: int, at: np.ndarray) -> np.ndarray:
        """Hashes of the windows that begin at these places, with the pattern of equal values."""
        codes, slots, back = self.codes[way], self.slots[way], self.back(way)
        out = np.full(len(at), size * 4 + way, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(size):
                p = at + k
                seen = np.where((slots[p] > 0) & (back[p] <= k), back[p], 0).astype(np.uint64)
                out = common.mix64(out ^ codes[p]) + seen
        return common.mix64(out)

    def literal(self, way: int, size: int) -> np.ndarray:
        """Whether each window has enough literal tokens for a template."""
        stretch = min(STRETCH, size)
        count = np.concatenate(([0], np.cumsum(self.slots[way] == 0)))
        enough = count[stretch:] - count[:-stretch] >= min(LITERAL, size)
        some = np.concatenate(([0], np.cumsum(enough)))
        return some[size - stretch + 1 :] > some[: len(some) - (size - stretch + 1)]

    def sentences(self, size: int, at: np.ndarray) -> np.ndarray:
        """Whether each window begins and ends where sentences do and has literal tokens enough for that."""
        count = np.concatenate(([0], np.cumsum(self.slots[SENTENCE] == 0)))
        return self.begins[at] & self.closes[at + size - 1] & (count[at + size] - count[at] >= min(SENTENCE_LITERAL, size))


class RollingHashes:
    """Hashes of windows of any size, from prefix sums."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        with np.errstate(over="ignore"):
            up, self.down = _powers(1 << max(17, n.bit_length()))
            self.sums = np.zeros(n + 1, np.uint64)
            np.cumsum(codes * up[:n], out=self.sums[1:])

    def of(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        if n <= 0:
            return np.empty(0, np.uint64)
        with np.errstate(over="ignore"):
            return common.mix64((self.sums[size:] - self.sums[:n]) * self.down[:n] + np.uint64(size))


@functools.lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE), np.full(n, INVERSE)
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(up), np.cumprod(down)


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, list[list[str]]]]:
    """(number of the first, tokens of each) of texts that follow each other, of about CHUNK tokens together."""
    held: list[list[str]] = []
    first = size = 0
    for i, t in enumerate(texts):
        held.append(TOKENS.findall(t) if t else [])
        size += len(held[-1])
        if size >= CHUNK:
            yield first, held
            held, first, size = [], i + 1, 0
    if held:
        yield first, held


def benchmark_windows(benchmark: DataFrame, *, key: str = "item_id", text: str = "text") -> DataFrame:
    """(h, h2, way, size, item, n, place) of every window of every item of n tokens. Stored."""
    names, types = ["h", "h2", "way", "size", "item", "n", "place"], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = TokenKinds()
        for batch in batches:
            for first, texts in _chunks(batch.column(1).to_pylist()):
                read = Readings(texts, kinds)
                lengths = np.diff(read.starts)
                for size in np.unique(np.minimum(lengths, RUN)).tolist():
                    for way in range(4) if LEAST <= size < RUN else range(3) if size >= LEAST else (2,):
                        if not size:
                            continue
                        # Windows that begin in an item of this size and end in it.
                        own = np.flatnonzero(np.minimum(lengths, RUN) == size)
                        at = np.concatenate([np.arange(read.starts[i], read.starts[i + 1] - size + 1) for i in own])
                        if way < 2:
                            at = at[read.literal(way, size)[at]]
                        elif way == SENTENCE:
                            at = at[~read.literal(0, size)[at]]
                            at = at[np.diff(np.concatenate(([0], np.cumsum(read.slots[way] == 0)))[np.stack([at, at + size])], axis=0)[0] >= SENTENCE_LITERAL]
                        item = np.searchsorted(read.starts, at, side="right") - 1
                        cols = [
                            common.signed(read.first_hashes(way).of(size)[at]), common.signed(read.second_hashes(way, size, at)), np.full(len(at), way), np.full(len(at), size),
                            batch.column(0).take(pa.array(item + first)), lengths[item], at - read.starts[item],
                        ]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) if isinstance(c, np.ndarray) else c for c, t in zip(cols, types, strict=True)], names=names)

    rows = benchmark.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return common.stored(rows.mapInArrow(spell, "h long, h2 long, way int, size int, item long, n long, place long"), "benchmark-windows")


def bitmap(windows: DataFrame) -> tuple[int, np.ndarray]:
    """(bits of a hash that it looks at, the bits) with 64 bits for a window, within 2**16 and 2**BITMAP_BITS: at most 16 MB."""
    bits = min(BITMAP_BITS, max(16, int(windows.count() * 64).bit_length()))
    place = F.shiftrightunsigned("h", 64 - bits) + 1
    found = windows.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    out = np.zeros((1 << (bits - 15), 4096), np.uint8)
    for r in found:
        out[r["bucket"] - 1] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return bits, out.reshape(-1)


def window_hits(docs: DataFrame, windows: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc, tkey, place, size, way, h, h2) of the documents' windows that may be the benchmark's. Stored.

    row numbers the rows of docs, doc is a row's id and tkey a hash of its text.
    """
    sizes = sorted((r["size"], r["way"]) for r in windows.select("size", "way").distinct().collect())  # at most 4 * RUN
    shared = docs.sparkSession.sparkContext.broadcast((*bitmap(windows), sizes))
    names = ["row", "doc", "tkey", "place", "size", "way", "h", "h2"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, row = TokenKinds(), TaskContext.get().partitionId() << 33
        bits, table, wanted = shared.value
        shift = np.uint64(64 - bits)
        for batch in batches:
            for first, texts in _chunks(batch.column(2).to_pylist()):
                read = Readings(texts, kinds)
                rolling = [read.first_hashes(way) for way in range(3)]
                rolling.append(rolling[0])
                for size, way in wanted:
                    h = rolling[way].of(size)
                    at = h >> shift
                    at = np.flatnonzero((table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1)
                    if not len(at):
                        continue
                    doc = np.searchsorted(read.starts, at, side="right") - 1
                    inside = at + size <= read.starts[doc + 1]
                    at, doc = at[inside], doc[inside]
                    if way == SENTENCE and len(at):
                        whole = read.sentences(size, at)
                        at, doc = at[whole], doc[whole]
                    if not len(at):
                        continue
                    source = pa.array(doc + first)
                    cols = [
                        pa.array(doc + first + row), batch.column(0).take(source), batch.column(1).take(source), pa.array(at - read.starts[doc]), pa.array(np.full(len(at), size, np.int32)), pa.array(np.full(len(at), way, np.int32)),
                        pa.array(common.signed(h[at])), pa.array(common.signed(read.second_hashes(way, size, at))),
                    ]
                    yield pa.RecordBatch.from_arrays(cols, names=names)
            row += batch.num_rows
        common.trim()

    rows = docs.select(F.col(key).cast("long").alias("doc"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("tkey"), F.col(text).alias("text"))
    return common.stored(rows.mapInArrow(find, "row long, doc long, tkey long, place long, size int, way int, h long, h2 long"), "window-hits")


#: Ranks of the readings: the most literal first.
_RANK = (1, 2, 0, 1)


def _classes(windows: DataFrame) -> DataFrame:
    """(h, h2, class, items): the number of a window's class, null up to SHARED items, and how many items it has."""
    out = windows.groupBy("h", "h2").agg(F.count_distinct(F.coalesce("item", F.lit(common.NULL_ID))).alias("items"))
    return out.select("h", "h2", F.when(F.col("items") > SHARED, F.xxhash64("h", "h2")).alias("class"), "items")


def members(benchmark: DataFrame, *, key: str = "item_id", text: str = "text") -> DataFrame:
    """(class, item_id) of the classes of more than SHARED items."""
    windows = benchmark_windows(benchmark, key=key, text=text)
    return windows.join(_classes(windows).where("class is not null"), ["h", "h2"]).select("class", F.col("item").alias("item_id")).distinct()


def matches(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc, tkey, item, n, size, item_place, rank, items, class): the windows of documents that are windows of items, once for each item
    that has the window. rank: 0 is the same word for word. class: null for up to SHARED items."""
    windows = benchmark_windows(benchmark)
    hits = window_hits(docs, windows, key=key, text=text).select("row", "doc", "tkey", "h", "h2").distinct()
    # A table of its own, so that Spark can split a window that very many documents hold.
    told = windows.join(_classes(windows), ["h", "h2"])
    told = told.select("h", "h2", "item", "n", "size", F.col("place").alias("item_place"), F.element_at(F.array(*map(F.lit, _RANK)), F.col("way") + 1).alias("rank"), "items", "class")
    return hits.join(common.stored(told, "benchmark-classes"), ["h", "h2"]).drop("h", "h2")


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document and benchmark item that leaked into it: doc_id, item_id, n_tokens, coverage, changed, n_items, classes.

    n_tokens of the item's tokens, its share ``coverage``, are in windows that the document has too; ``changed``
    says that some have other values. An item's coverage is that of all its windows, whoever else has them, and each
    item has its row. n_items is the greatest number of items that share one of the windows, and ``classes`` has the numbers of those that more
    than SHARED share, whose items ``members`` lists (empty: there are none).

    Null and empty texts and items match nothing; items of fewer than LEAST tokens match as they are, case aside; very long texts are read in
    chunks; repeated rows give a row each; an empty table or benchmark gives no rows; null ids stay null; other columns are not used.
    """
    found = matches(docs, benchmark, key=key, text=text)
    places = found.groupBy("row", "doc", "item", "n", "size", "item_place").agg(F.min("rank").alias("rank"), F.max("items").alias("items"), F.first("class", ignorenulls=True).alias("class"))
    grouped = places.groupBy("row", "doc", "item", "n", "size").agg(F.array_sort(F.collect_list("item_place")).alias("places"), F.max("rank").alias("rank"), F.max("items").alias("n_items"), F.array_sort(F.collect_set("class")).alias("classes"))
    # Windows of one size overlap unless they are that far apart.
    size, begin = F.col("size").cast("long"), F.struct(F.lit(None).cast("long").alias("last"), F.lit(0).cast("long").alias("total"))
    tokens = F.aggregate("places", begin, lambda so_far, p: F.struct(p.alias("last"), (so_far["total"] + F.coalesce(F.least(size, p - so_far["last"]), size)).alias("total")), lambda so_far: so_far["total"])
    return grouped.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), tokens.alias("n_tokens"), (tokens / F.col("n")).alias("coverage"), (F.col("rank") > 0).alias("changed"), "n_items", "classes")


def without_leaks(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, that hold no leak; rows of equal id and text share their fate.

    Null and empty texts stay, repeated rows stay, an empty table or benchmark takes nothing.
    """
    own = "_rasterloom_tkey"  # a column of docs could be called tkey
    windows = benchmark_windows(benchmark)
    hits = window_hits(docs, windows, key=key, text=text)
    found = common.stored(hits.join(windows.select("h", "h2").distinct(), ["h", "h2"], "left_semi").select("doc", "tkey").distinct(), "leaking")
    rows = docs.withColumn(own, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    same = rows[key].cast("long").eqNullSafe(found["doc"]) & (rows[own] == found["tkey"])
    return rows.join(found, same, "left_anti").drop(own)
