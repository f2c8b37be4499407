"""Token counts of fields or sections, from the offsets of whole encoded documents.

A document is encoded once, as a whole; its tokens' character spans are then
joined with the sections' spans. A token that crosses a boundary is allocated by
one of these rules:

- ``first``: to the section that holds its first character;
- ``last``: to the section that holds its last character;
- ``most``: to the section that holds most of its characters, the earliest of equals;
- ``split``: to each section by its share of the token's characters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.tokens import encoder

#: Pieces whose spans a Python worker keeps.
KEPT_SPANS = 400_000
RULES = ("first", "last", "most", "split")


def lines(text: str) -> list[int]:
    """Starts of the lines; a line feed belongs to the line that it ends."""
    out, at = [0], text.find("\n")
    while at >= 0:
        if at + 1 < len(text):
            out.append(at + 1)
        at = text.find("\n", at + 1)
    return out


def allocate(spans: np.ndarray, starts: np.ndarray, length: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of each section, for sections that cover 0..length.

    Tokens are an interval join: binary search of each span's ends in the section
    starts. Spans that are empty count by their start.
    """
    n = len(starts)
    if not len(spans):
        return np.zeros(n), np.zeros(n, np.int64)
    begin, end = spans[:, 0], np.maximum(spans[:, 1], spans[:, 0] + 1)
    a = np.searchsorted(starts, begin, side="right") - 1
    b = np.searchsorted(starts, end - 1, side="right") - 1
    crossing = np.bincount(np.concatenate([np.arange(i, j + 1) for i, j in zip(a[a != b], b[a != b], strict=True)]), minlength=n) if (a != b).any() else np.zeros(n, np.int64)
    if rule == "first":
        return np.bincount(a, minlength=n).astype(float), crossing
    if rule == "last":
        return np.bincount(b, minlength=n).astype(float), crossing
    counts = np.bincount(a[a == b], minlength=n).astype(float)
    ends = np.append(starts[1:], length)
    for s, e, i, j in zip(begin[a != b], end[a != b], a[a != b], b[a != b], strict=True):
        shares = np.minimum(ends[i : j + 1], e) - np.maximum(starts[i : j + 1], s)
        if rule == "most":
            counts[i + int(np.argmax(shares))] += 1
        else:
            counts[i : j + 1] += shares / (e - s)
    return counts, crossing


def attribute_sections(
    docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", sections: Callable[[str], list[int]] = lines, rule: str = "most"
) -> DataFrame:
    """A row for each section of each document: doc_id, section, start, end (characters), n_tokens, n_crossing.

    Null and empty texts have one empty section of no tokens. Repeated rows give repeated
    results, null keys stay null; very long texts are encoded whole; an empty table gives no rows; other
    columns are not used.
    """
    if rule not in RULES:
        raise ValueError(f"rule {rule!r} is not one of {RULES}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            out: list[tuple[np.ndarray, ...]] = []
            ids: list[tuple[int | None, int]] = []
            for k, t in zip(keys, texts, strict=True):
                starts = np.array(sections(t), np.int64)
                counts, crossing = allocate(encoder(tokenizer, KEPT_SPANS).offsets(t), starts, len(t), rule)
                out.append((np.arange(len(starts)), starts, np.append(starts[1:], len(t)), counts, crossing))
                ids.append((k, len(starts)))
            if out:
                cols = [np.concatenate(c) for c in zip(*out, strict=True)]
                doc = pa.array([k for k, _ in ids], pa.int64()).take(pa.array(np.repeat(np.arange(len(ids)), [n for _, n in ids])))
                yield pa.RecordBatch.from_arrays([doc, *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", *names])

    names, types = ["section", "start", "end", "n_tokens", "n_crossing"], [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(count, "doc_id long, section long, start long, end long, n_tokens double, n_crossing long")


def attribute_fields(docs: DataFrame, tokenizer: str, fields: Sequence[str], *, key: str = "doc_id", separator: str = "\n", rule: str = "most") -> DataFrame:
    """Token counts of columns that are encoded together, joined by ``separator``; null fields are empty.

    A separator belongs to the field before it. The row's section is the field's name. Null and empty fields have no
    tokens, a row of such fields alone those of its separators; null keys stay null, repeated rows give repeated results, very long
    fields are encoded whole, an empty table gives no rows, other columns are not used.
    """
    if rule not in RULES:
        raise ValueError(f"rule {rule!r} is not one of {RULES}")
    names = list(fields)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                values = [row[f"f{i}"] or "" for i in range(len(names))]
                widths = [len(v) + len(separator) * (i < len(names) - 1) for i, v in enumerate(values)]
                starts = np.concatenate(([0], np.cumsum(widths)[:-1])).astype(np.int64)
                whole = separator.join(values)
                used = np.flatnonzero(np.array(widths) > 0)  # empty fields hold no character
                counts = np.zeros(len(names))
                if len(used):
                    counts[used] = allocate(encoder(tokenizer, KEPT_SPANS).offsets(whole), starts[used], len(whole), rule)[0]
                rows += [{"doc_id": row["key"], "field": n, "n_tokens": float(c)} for n, c in zip(names, counts, strict=True)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("field", pa.string()), ("n_tokens", pa.float64())]))

    cols = [F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(names)]
    return docs.select(F.col(key).cast("long").alias("key"), *cols).mapInArrow(count, "doc_id long, field string, n_tokens double")
