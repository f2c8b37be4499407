"""Removal of repeated byte strings by hash-compared suffix sorting.

Every string of SPAN bytes has an anchor: among its grams of GRAM bytes, the
one of least hash, the first of equals. Equal strings have equal anchors at
equal places, so only strings of one anchor need comparing. Strings with the
same anchor that follow each other in a document are a run, of less than
SPAN + SPAN bytes. Runs whose anchor occurs once are left; equal runs are
counted and taken once: they are told by hash, and the bytes of each are compared with
a representative's; should they differ, all is done again with another hash.

An anchor of many different runs is cut before it is sorted: a string that begins at most d bytes before its
anchor has so many bytes behind it, one that begins earlier has so many before it, and equal strings
agree in them, so runs are dealt by those bytes to groups for each half of the depths, again and again
until a group is small or one depth is left.

The rest is suffix sorting around anchors: prefix polynomial hashes and binary
search find common extensions, so a comparison takes logarithmic time; a
mergesort orders what follows the anchors, and another what precedes them, read
backwards. The common extensions of neighbours are verified byte by byte. Two
strings are equal if they share a class of the first order at one depth and one
of the second at the other.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm import common

SPAN = 200
GRAM = 32
WIDTH = SPAN - GRAM + 1
#: Bytes whose anchors are found at once, or up to twice as many; a task holds some 100 bytes for each.
CHUNK = 1 << 17
#: Different runs that are sorted together; a larger group is cut by the bytes next to its anchor.
CAP = 2048
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
PLACE = np.uint64((1 << 22) - 1)
#: Bytes of runs that a task keeps to compare copies with.
SEEN_BYTES = 48 << 20


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64."""
    up, down = np.full(n, BASE), np.full(n, INVERSE)
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(up), np.cumprod(down)


def prefix_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of byte * BASE**i, and BASE**-i: the hash of i..j is (sum[j] - sum[i]) * BASE**-i."""
    size = 1 << max(19, int(len(data) + 1).bit_length())
    up, down = _powers(size)
    sums = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums, down


def runs_of(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first string, strings, anchor's place, anchor's hash) of each run, for texts that begin at ``starts`` of data."""
    none = np.empty(0, np.int64)
    if len(data) < SPAN:
        return none, none, none, np.empty(0, np.uint64)
    sums, down = prefix_hashes(data)
    with np.errstate(over="ignore"):
        grams = common.mix64((sums[GRAM:] - sums[:-GRAM]) * down[: len(data) - GRAM + 1])
    order = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
    padded = np.full(-(-len(order) // WIDTH) * WIDTH, np.uint64(2**64 - 1))
    padded[: len(order)] = order
    table = padded.reshape(-1, WIDTH)
    ahead = np.minimum.accumulate(table, axis=1).reshape(-1)
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    n = len(data) - SPAN + 1
    place = (np.minimum(back[:n], ahead[WIDTH - 1 : WIDTH - 1 + n]) & PLACE).astype(np.int64)
    ends = np.append(starts[1:], len(data))
    last = np.maximum(starts, ends - SPAN + 1)  # strings of a text begin before this
    change = np.zeros(n + 1, bool)
    change[1:n] = place[1:] != place[:-1]
    change[starts[starts < n]] = True
    inside = np.zeros(len(data) + 2, np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, last, -1)
    first = np.flatnonzero(change[:n] & (np.cumsum(inside)[:n] > 0))
    if not len(first):
        return none, none, none, np.empty(0, np.uint64)
    text = np.searchsorted(starts, first, side="right") - 1
    stop = np.minimum(np.append(first[1:], n), last[text])
    return first, stop - first, place[first], grams[place[first]]


def _chunks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]]:
    """(data, starts, (text, offset) of each start) of about CHUNK bytes; a longer text comes in parts that overlap."""
    data: list[bytes] = []
    starts: list[int] = []
    origin: list[tuple[int, int]] = []
    size = 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - SPAN + 1), CHUNK):
            part = t[at : at + CHUNK + SPAN - 1]
            if len(part) < SPAN:
                continue
            if size and size + len(part) > 2 * CHUNK:
                yield np.frombuffer(b"".join(data), np.uint8), np.array(starts), origin
                data, starts, origin, size = [], [], [], 0
            data.append(part)
            starts.append(size)
            origin.append((i, at))
            size += len(part)
            if size >= CHUNK:
                yield np.frombuffer(b"".join(data), np.uint8), np.array(starts), origin
                data, starts, origin, size = [], [], [], 0
    if data:
        yield np.frombuffer(b"".join(data), np.uint8), np.array(starts), origin


class Suffixes:
    """Sorts suffixes within groups; comparisons go by the common extension of prefix hashes."""

    def __init__(self, data: np.ndarray, start: np.ndarray, length: np.ndarray):
        self.data, self.start, self.length = data, start, length
        self.fresh: np.ndarray | None = None  # where a group begins, once sorted
        self.sums, self.down = prefix_hashes(data)

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes x and y."""
        a, b = self.start[x], self.start[y]
        low, high = np.zeros(len(x), np.int64), np.minimum(self.length[x], self.length[y])
        with np.errstate(over="ignore"):
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    return low
                mid = (low[open_] + high[open_] + 1) // 2
                p, q = a[open_], b[open_]
                same = (self.sums[p + mid] - self.sums[p]) * self.down[p] == (self.sums[q + mid] - self.sums[q]) * self.down[q]
                low[open_[same]] = mid[same]
                high[open_[~same]] = mid[~same] - 1

    def less(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """x before y; equal suffixes go by number, and -1 comes last."""
        out = (x >= 0) & (y < 0)
        both = np.flatnonzero((x >= 0) & (y >= 0))
        if len(both):
            p, q = x[both], y[both]
            n = self.extension(p, q)
            over = np.array([n == self.length[p], n == self.length[q]])
            last = max(0, len(self.data) - 1)
            by_byte = self.data[np.minimum(self.start[p] + n, last)] < self.data[np.minimum(self.start[q] + n, last)]
            out[both] = np.where(over[0] & over[1], p < q, np.where(over[0], True, np.where(over[1], False, by_byte)))
        return out

    def merged(self, table: np.ndarray, width: int) -> np.ndarray:
        """Rows hold sorted runs of ``width``; each two neighbours become one, by ranks found in the other."""
        groups, total = table.shape
        pairs = table.reshape(groups * total // (2 * width), 2, width)
        out = np.empty((len(pairs), 2 * width), np.int64)
        row = np.repeat(np.arange(len(pairs)), width)
        column = np.tile(np.arange(width), len(pairs))
        for side in (0, 1):
            own, other = pairs[:, side].reshape(-1), pairs[:, 1 - side]
            low, high = np.zeros(len(own), np.int64), np.full(len(own), width)
            while (open_ := np.flatnonzero(low < high)).size:
                mid = (low[open_] + high[open_]) // 2
                theirs = other[row[open_], mid]
                before = self.less(theirs, own[open_])
                if side:  # of two that are absent, the left goes first
                    before |= (theirs < 0) & (own[open_] < 0)
                low[open_[before]] = mid[before] + 1
                high[open_[~before]] = mid[~before]
            out[row, column + low] = own
        return out.reshape(groups, total)

    def sort(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order within groups (which are in order themselves), and the common extension of each with the one before."""
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        sizes = np.diff(np.append(first, len(group)))
        order = np.empty(len(group), np.int64)
        level = np.ceil(np.log2(np.maximum(sizes, 1))).astype(int)
        for c in np.unique(level):
            which = np.flatnonzero(level == c)
            column = np.arange(1 << c)
            table = np.where(column < sizes[which][:, None], first[which][:, None] + column, -1)
            width = 1
            while width < table.shape[1]:
                table = self.merged(table, width)
                width *= 2
            order[(first[which][:, None] + column)[column < sizes[which][:, None]]] = table[table >= 0]
        common_ = np.zeros(len(group), np.int64)
        self.fresh = np.concatenate(([True], group[1:] != group[:-1]))
        inner = np.flatnonzero(~self.fresh)
        common_[inner] = self.extension(order[inner - 1], order[inner])
        return order, common_

    def verify(self, order: np.ndarray, common_: np.ndarray) -> bool:
        """Whether each common extension holds byte by byte and no longer one does, and the later suffix is no less: then
        the whole order is right, since it is so for each two neighbours."""
        inner = np.flatnonzero(~self.fresh)
        if not len(inner):
            return True
        x, y, n = order[inner - 1], order[inner], common_[inner]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        if (self.data[np.repeat(self.start[x], n) + step] != self.data[np.repeat(self.start[y], n) + step]).any():
            return False
        left, right = self.length[x] - n, self.length[y] - n
        if ((left < 0) | (right < 0) | ((right == 0) & (left > 0))).any():
            return False
        both = np.flatnonzero((left > 0) & (right > 0))
        return bool((self.data[self.start[x[both]] + n[both]] < self.data[self.start[y[both]] + n[both]]).all())


def plain_sort(data: np.ndarray, start: np.ndarray, length: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same order by the bytes themselves, for the case that a hash collides."""
    text = [data[s : s + n].tobytes() for s, n in zip(start, length, strict=True)]
    order = np.array(sorted(range(len(text)), key=lambda k: (group[k], text[k], k)), np.int64)
    common_ = np.zeros(len(order), np.int64)
    for k in range(1, len(order)):
        x, y = text[order[k - 1]], text[order[k]]
        if group[order[k - 1]] == group[order[k]]:
            n = min(len(x), len(y))
            common_[k] = next((i for i in range(n) if x[i] != y[i]), n)
    return order, common_


def classes_by_depth(data: np.ndarray, start: np.ndarray, length: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    suffixes = Suffixes(data, start, length)
    order, common_ = suffixes.sort(group)
    if not suffixes.verify(order, common_):
        order, common_ = plain_sort(data, start, length, group)
    return order, common_


def repeated_strings(contents: list[bytes], anchor: np.ndarray, group: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None) -> list[list[int]]:
    """For runs of equal anchors in equal groups (in order), the strings of each that occur in another run of its
    group: [first, end, first, end, ...]. low, high: the depths of the strings that count, by run; all if absent."""
    low, high = np.zeros(len(anchor), np.int64) if low is None else low, np.full(len(anchor), WIDTH - 1) if high is None else high
    length = np.array([len(c) for c in contents], np.int64)
    start = np.concatenate(([0], np.cumsum(length)[:-1]))
    data = np.frombuffer(b"".join(contents), np.uint8)
    after, after_common = classes_by_depth(data, start + anchor, length - anchor, group)
    before, before_common = classes_by_depth(data[::-1].copy(), len(data) - start - anchor, anchor, group)
    fresh = np.concatenate(([True], group[1:] != group[:-1]))
    strings = length - SPAN + 1
    covered = np.zeros(int(strings.sum()), bool)
    base = np.concatenate(([0], np.cumsum(strings)[:-1]))
    right, left = np.empty(len(group), np.int64), np.empty(len(group), np.int64)
    for depth in range(WIDTH):
        at = anchor - depth  # the string that begins ``depth`` bytes before the anchor
        which = np.flatnonzero((at >= 0) & (at < strings) & (low <= depth) & (depth <= high))
        if len(which) < 2:
            continue
        right[after] = np.cumsum(fresh | (after_common < SPAN - depth))
        left[before] = np.cumsum(fresh | (before_common < depth))
        code = right[which] * (len(group) + 1) + left[which]
        order = np.argsort(code, kind="stable")
        same = code[order][1:] == code[order][:-1]
        twice = np.concatenate((same, [False])) | np.concatenate(([False], same))
        hit = which[order[twice]]
        covered[base[hit] + at[hit]] = True
    out = []
    for k in range(len(contents)):
        mine = covered[base[k] : base[k] + strings[k]]
        if not mine.any():
            out.append([])
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([0], mine.view(np.int8), [0]))))
        out.append(edge.tolist())
    return out


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    words = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).cast("long").alias("doc"), F.xxhash64(words).alias("tkey"), words.alias("text"))


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in batch.column(column).to_pylist()]


def repeated_anchors(runs: DataFrame) -> DataFrame:
    """mh: hashes of anchors of two runs or more, anywhere; counted in each task before the shuffle.

    Stored: as a table of its own it lets Spark split an anchor that very many runs have when both are joined.
    """
    return common.stored(runs.groupBy("mh").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("mh"), "repeated-anchors")


def all_runs(rows: DataFrame) -> DataFrame:
    """(mh, doc, tkey, run): run holds the first string's offset, the number of strings and the anchor's place among them."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                docs, tkeys = part.column(0), part.column(1)
                for data, starts, origin in _chunks(_texts(part, 2)):
                    first, strings, place, mh = runs_of(data, starts)
                    which = np.searchsorted(starts, first, side="right") - 1
                    text, offset = np.array(origin)[which].T if len(which) else (np.empty(0, np.int64),) * 2
                    run = (offset + first - starts[which]) << 16 | strings << 8 | (place - first)
                    yield pa.RecordBatch.from_arrays([pa.array(common.signed(mh)), docs.take(pa.array(text)), tkeys.take(pa.array(text)), pa.array(run)], names=["mh", "doc", "tkey", "run"])
        _powers.cache_clear()
        common.trim()

    return rows.mapInArrow(find, "mh long, doc long, tkey long, run long")


def run_contents(rows: DataFrame, seed: int = 0) -> DataFrame:
    """(mh, hi, lo, doc, tkey, run, content) of each run whose anchor is repeated; hi and lo are a hash of the content,
    which stands where a task meets it first, and wherever its bytes differ from those. Stored."""
    found = common.stored(all_runs(rows), "all-runs")
    anchors = repeated_anchors(found)
    # Rows of one id and text have the same runs, so they are taken once; each such row is cut below.
    wanted = found.join(anchors, "mh").groupBy("doc", "tkey").agg(F.collect_set(F.struct("run", "mh")).alias("found")).select("doc", "tkey", F.col("found.mh").alias("anchors"), F.col("found.run").alias("runs"))
    wanted = common.stored(wanted, "wanted-runs")
    common.discard(found)
    common.discard(anchors)
    texts = rows.join(wanted, rows["doc"].eqNullSafe(wanted["doc"]) & (rows["tkey"] == wanted["tkey"])).select(rows["doc"], rows["tkey"], rows["text"], wanted["anchors"], wanted["runs"])
    names = ["mh", "hi", "lo", "doc", "tkey", "run", "content"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, bytes] = {}
        held = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                row: list[int] = []
                mh: list[np.ndarray] = []
                run: list[np.ndarray] = []
                hashes: list[bytes] = []
                contents: list[bytes | None] = []
                for i, raw in enumerate(_texts(part, 2)):
                    own, first = np.unique(part.column(4)[i].values.to_numpy(), return_index=True)
                    mh.append(part.column(3)[i].values.to_numpy()[first])
                    run.append(own)
                    row += [i] * len(own)
                    for p, n in zip((own >> 16).tolist(), (own >> 8 & 255).tolist(), strict=True):
                        content = raw[p : p + n + SPAN - 1]
                        h = content_hash(content, seed)
                        hashes.append(h)
                        if (same := seen.get(h)) is None:
                            seen[h] = content
                            held += len(content)
                        contents.append(None if same == content else content)
                if held > SEEN_BYTES:
                    seen.clear()
                    held = 0
                if row:
                    words = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
                    at_row = pa.array(row)
                    cols = [pa.array(np.concatenate(mh)), pa.array(words[:, 0]), pa.array(words[:, 1]), part.column(0).take(at_row), part.column(1).take(at_row), pa.array(np.concatenate(run)), pa.array(contents, pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, names=names)

    runs = common.stored(texts.mapInArrow(cut, "mh long, hi long, lo long, doc long, tkey long, run long, content binary"), "runs")
    common.discard(wanted)
    return runs


def content_hash(content: bytes, seed: int) -> bytes:
    return xxhash.xxh3_128_digest(content, seed=seed)


#: Marks a run whose hash another one has too.
_DIFFERS = [-1]
_PIECE = "g long, hi long, lo long, anchor int, low int, high int, content binary"


def _halves(pieces: DataFrame) -> DataFrame:
    """Each piece's strings in two: those that begin at most the middle depth before the anchor, dealt by the bytes behind it, and the others by those before it."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for g, hi, lo, anchor, low, high, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                middle, strings = (low + high) // 2, len(content) - SPAN + 1
                for a, b, key in ((low, middle, content[anchor : anchor + SPAN - middle]), (middle + 1, high, content[anchor - middle - 1 : anchor] if anchor > middle else b"")):
                    if max(a, anchor - strings + 1) <= min(b, anchor):
                        to = xxhash.xxh3_64_intdigest(key, seed=(g ^ a * 0x9E3779B97F4A7C15) & (2**64 - 1))
                        out.append((to - (to >> 63 << 64), hi, lo, anchor, a, b, content))
            cols = list(zip(*out, strict=True)) if out else [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=batch.schema.names)

    return pieces.mapInArrow(deal, _PIECE)


def _of_one_depth(pieces: DataFrame) -> DataFrame:
    """(hi, lo, strings) for pieces of one string each, which are equal or not as bytes."""
    one = pieces.select("hi", "lo", (F.col("anchor") - F.col("low")).alias("at"), F.substring("content", F.col("anchor") - F.col("low") + 1, F.lit(SPAN)).alias("string"))
    often = common.stored(one.groupBy("string").agg(F.count_distinct("hi", "lo", "at").alias("n")).where("n > 1").select("string"), "equal-strings")
    return one.join(often, "string").select("hi", "lo", F.array("at", F.col("at") + 1).alias("strings"))


def compared_runs(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """(hi, lo, strings): which strings of runs that occur once are in another run of their anchor; strings of [-1] mark a hash of two different runs."""
    sizes = common.stored(counts.groupBy("mh").agg(F.count(F.lit(1)).alias("members"), F.max("n").alias("most")), "anchor-sizes")
    contents = runs.where("content is not null").select("mh", "hi", "lo", (F.col("run").bitwiseAND(255)).cast("int").alias("anchor"), "content")
    whole = contents.select(F.col("mh").alias("g"), "hi", "lo", "anchor", F.lit(0).alias("low"), F.lit(WIDTH - 1).alias("high"), "content")
    once = counts.where("n = 1").select(F.col("mh").alias("g"), "hi", "lo", F.lit(1).alias("anchor"), F.lit(0).alias("low"), F.lit(WIDTH - 1).alias("high"), F.lit(None).cast("binary").alias("content"))
    # Contents are shuffled once: an anchor of one run, several times, comes along, to compare its copies with one of them.
    found = [_sorted_groups(whole.unionByName(once).join(sizes.where(f"members <= {CAP} and (members > 1 or most > 1)").select(F.col("mh").alias("g")), "g"), marked=True)]
    # Few, and a table of their own, so that Spark can broadcast them rather than shuffle all contents.
    large = common.stored(sizes.where(f"members > {CAP}").select(F.col("mh").alias("g")), "large-anchors")
    if not large.isEmpty():
        pieces = common.stored(whole.join(large, "g"), "pieces")
        # Different contents of one hash, before copies go.
        found.append(pieces.groupBy("hi", "lo").agg(F.min("content").alias("least"), F.max("content").alias("largest")).where("least <> largest").select("hi", "lo", F.array(F.lit(-1)).alias("strings")))
        pieces = pieces.dropDuplicates(["g", "hi", "lo"])
        while True:
            pieces = common.stored(_halves(pieces), "pieces")
            groups = common.stored(pieces.groupBy("g").agg(F.count(F.lit(1)).alias("members"), F.max(F.col("high") - F.col("low")).alias("depths")).where("members > 1"), "piece-groups")
            found.append(_sorted_groups(pieces.join(groups.where(f"members <= {CAP}").select("g"), "g"), marked=False))
            large = groups.where(f"members > {CAP}").select("g", "depths")
            if large.isEmpty():
                break
            rest = pieces.join(large, "g")
            # Copies of one string at one depth are no group to be sorted.
            found.append(_of_one_depth(rest.where("low = high")))
            pieces = rest.where("low < high").drop("depths")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _sorted_groups(pieces: DataFrame, marked: bool) -> DataFrame:
    """(hi, lo, strings) of groups of at most CAP runs. marked: only runs with a row without content count, as they occur once."""
    placed = pieces.select("g", "hi", "lo", "anchor", "low", "high", "content").repartition(common.parts(pieces.sparkSession), "g").sortWithinPartitions("g", "low", "hi", "lo", "content")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Whole groups are compared together, up to about CAP runs.
        held: list[tuple] = []
        differ: list[tuple[int, int]] = []
        mark = None  # a row without content, which comes first, says that its run occurs once

        def compared() -> pa.RecordBatch:
            columns = [np.array([r[k] for r in held], np.int64) for k in (0, 3, 4, 5)]
            found = repeated_strings([r[6] for r in held], columns[1], columns[0], columns[2], columns[3]) if held else []
            out = [(r[1], r[2], f) for r, f in zip(held, found, strict=True) if f and (r[7] or not marked)] + [(*d, _DIFFERS) for d in differ]
            differ.clear()
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.list_(pa.int32()))], names=["hi", "lo", "strings"])

        def drop_single() -> None:
            if held and (len(held) == 1 or held[-2][0] != held[-1][0]):
                held.pop()  # a group of one run, whose copies have been compared with it

        for batch in batches:
            for g, hi, lo, anchor, low, high, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if content is None:
                    mark = hi, lo
                    continue
                if held and held[-1][:3] == (g, hi, lo) and held[-1][4] == low:
                    if held[-1][6] != content:
                        differ.append((hi, lo))
                    continue
                if held and held[-1][0] != g:
                    drop_single()
                    if len(held) >= CAP:
                        yield compared()
                        held.clear()
                held.append((g, hi, lo, anchor, low, high, content, mark == (hi, lo)))
        drop_single()
        if held or differ:
            yield compared()
            held.clear()
        _powers.cache_clear()
        common.trim()

    return placed.mapInArrow(compare, "hi long, lo long, strings array<int>")


def repeated_spans(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, tkey, spans): byte ranges of each text, as [start, end] pairs that may overlap, that repeated strings cover. Stored; nothing else is left."""
    spark, seed = docs.sparkSession, 0
    with common.scratch_scope([]) as done:
        while True:
            runs = run_contents(_rows(docs, key, text), seed)
            counts = common.stored(runs.groupBy("mh", "hi", "lo").agg(F.count(F.lit(1)).alias("n")), "run-counts")
            with common.scratch_scope([]) as compared:
                found = compared_runs(runs, counts)
            found = common.stored(found, "repeated-strings")
            common.delete_paths(spark, compared)
            if found.where(F.get("strings", F.lit(0)) < 0).isEmpty():
                break
            common.delete_paths(spark, done)
            seed += 1  # two different runs had one hash
    whole = counts.where("n > 1").select("hi", "lo", F.array(F.lit(0), F.lit(1 << 20)).alias("strings"))
    covered = whole.unionByName(found)
    hits = runs.select("hi", "lo", "doc", "tkey", "run").join(covered, ["hi", "lo"])
    offset, strings = F.shiftright("run", 16), F.shiftright("run", 8).bitwiseAND(255).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), (F.size("strings") / 2).cast("int") - 1), lambda i: F.array(offset + F.element_at("strings", 2 * i + 1), offset + F.least(F.element_at("strings", 2 * i + 2), strings) + (SPAN - 1)))
    spans = common.stored(hits.select("doc", "tkey", pairs.alias("spans")).groupBy("doc", "tkey").agg(F.flatten(F.collect_set("spans")).alias("spans")), "spans")
    common.delete_paths(spark, done)
    return spans


def merged(spans: list[list[int]] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _with_spans(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The columns of docs and the spans."""
    spans = repeated_spans(docs, key=key, text=text)
    own = "_rasterloom_tkey"  # a column of docs could be called tkey
    rows = docs.withColumn(own, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    same = rows[key].cast("long").eqNullSafe(spans["doc"]) & (rows[own] == spans["tkey"])
    return rows.join(spans, same, "left").select(*(rows[c] for c in docs.columns), spans["spans"].alias("_rasterloom_spans"))


def digest_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row.

    Null and empty texts have no bytes; texts below SPAN bytes lose none; repeated rows are
    occurrences of their own, so each loses what it shares with the other; null ids stay null;
    an empty table gives no rows; other columns are not used.
    """
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    kinds = [pa.int64()] * 4 + [pa.string()]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                out: list[tuple] = []
                for doc, t, spans in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    raw, found = (t or "").encode("utf-8", "surrogatepass"), merged(spans)
                    at, kept = 0, hashlib.sha256()
                    for a, b in found:
                        kept.update(raw[at:a])
                        at = b
                    kept.update(raw[at:])
                    out.append((doc, len(raw), sum(b - a for a, b in found), len(found), kept.hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    rows = _with_spans(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), "doc_id", "text")
    return rows.mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut(text: str | None, spans: list[list[int]] | None) -> str | None:
    """The text without its spans; a character that a span covers in part goes with it."""
    if not spans:
        return text
    raw, out, at = text.encode("utf-8", "surrogatepass"), [], 0
    for a, b in merged(spans):
        out.append(raw[at:a])
        at = b
    out.append(raw[at:])
    return "".join(p.decode("utf-8", "ignore") for p in out)


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """The rows of docs with repeated strings cut from the text and n_chars set anew; texts that vanish go."""
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(columns.index(text)).to_pylist()
            new = [cut(t, s) for t, s in zip(texts, batch.column(len(columns)).to_pylist(), strict=True)]
            keep = pa.array([not (t and t.strip()) or bool(x and x.strip()) for t, x in zip(texts, new, strict=True)], pa.bool_())
            cols = [batch.column(i) for i in range(len(columns))]
            cols[columns.index(text)] = pa.array(new, batch.schema.field(columns.index(text)).type)
            if n_chars in columns:
                i = columns.index(n_chars)
                cols[i] = pa.array([old if x == t else len(x) for old, x, t in zip(cols[i].to_pylist(), new, texts, strict=True)], batch.schema.field(i).type)
            yield pa.RecordBatch.from_arrays(cols, names=columns).filter(keep)

    return _with_spans(docs, key, text).mapInArrow(run, docs.schema)
