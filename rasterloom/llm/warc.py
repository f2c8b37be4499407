"""WARC archives in Zstandard: a dictionary in the leading skippable frame, one frame per record.

Each archive begins with a skippable frame (magic 0x184D2A5D) that holds the
dictionary; every record is one frame compressed with it, so a reader may begin
at any frame. Payloads that were met before are revisit records, which name the
first one. The reader checks magic, version line, header fields, lengths and
digests, and fails on the first that is wrong.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm import common
from rasterloom.llm.pfor import open_fs

DICTIONARY_MAGIC = 0x184D2A5D
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
CRLF = b"\r\n"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")


class WarcError(ValueError):
    """An archive that is not as it should be."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def escaped(url: str) -> str:
    """Bytes of white space, control characters and '%5C' as '%5C' and two hexadecimal digits: a header line
    cannot hold them or would lose them, and a reader gets the address back as it was."""
    return re.sub(r"[\s\x00-\x1f\x7f]|%5C", lambda m: "".join(f"%5C{b:02X}" for b in m[0].encode()), url)


def unescaped(field: str) -> str:
    return re.sub(r"(?:%5C[0-9A-F]{2})+", lambda m: bytes.fromhex(m[0].replace("%5C", "")).decode(), field)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """A response, or with ``refers_to`` a revisit that carries no payload."""
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'null' if page_id is None else page_id}>"), ("WARC-Date", DATE),
        ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", escaped(url)))
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields.append(("Content-Length", str(len(block))))
    head = CRLF.join([VERSION, *(f"{k}: {v}".encode() for k, v in fields)])
    return head + CRLF + CRLF + block + CRLF + CRLF


class ArchiveWriter:
    """Records in, one archive out. The dictionary is trained on the first ``sample`` bytes of records, which are held until then."""

    def __init__(self, stream, *, level: int = 3, sample: int = 1 << 18, dictionary_bytes: int = 1 << 14):
        self.stream, self.level, self.sample, self.dictionary_bytes = stream, level, sample, dictionary_bytes
        self.held: list[bytes] = []
        self.held_bytes = self.size = self.records = 0
        self.compressor: zstd.ZstdCompressor | None = None

    def _begin(self) -> None:
        cuts = [r[i : i + 4096] for r in self.held for i in range(0, min(len(r), self.sample), 4096)]
        try:
            trained = zstd.train_dictionary(min(self.dictionary_bytes, max(256, self.held_bytes // 8)), cuts).as_bytes()
        except zstd.ZstdError:  # too few or too uniform samples to train on
            trained = (b"".join(cuts)[: self.dictionary_bytes]).ljust(8, b"\n")
        kind = zstd.DICT_TYPE_FULLDICT if trained[:4] == b"\x37\xa4\x30\xec" else zstd.DICT_TYPE_RAWCONTENT
        self.compressor = zstd.ZstdCompressor(level=self.level, dict_data=zstd.ZstdCompressionDict(trained, dict_type=kind), write_content_size=True, write_checksum=True)
        stored = zstd.ZstdCompressor(level=19).compress(trained)
        self._put(struct.pack("<II", DICTIONARY_MAGIC, len(stored)) + stored)
        for r in self.held:
            self._put(self.compressor.compress(r))
        self.held = []

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def add(self, data: bytes) -> None:
        self.records += 1
        if self.compressor is not None:
            self._put(self.compressor.compress(data))
            return
        self.held.append(data)
        self.held_bytes += len(data)
        if self.held_bytes >= self.sample:
            self._begin()

    def close(self) -> int:
        if self.compressor is None:
            self._begin()
        return self.size


def _dictionary(frame: bytes) -> zstd.ZstdCompressionDict:
    raw = zstd.ZstdDecompressor().decompress(frame) if frame[:4] == b"\x28\xb5\x2f\xfd" else frame
    return zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstd.DICT_TYPE_RAWCONTENT)


def read_frames(source, buffer: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive, one decompressed frame each; memory holds a buffer and one record."""
    head = source.read(8)
    if len(head) < 8:
        raise WarcError("no dictionary frame")
    magic, size = struct.unpack("<II", head)
    if magic != DICTIONARY_MAGIC:
        raise WarcError(f"leading frame has magic {magic:#x}")
    frame = source.read(size)
    if len(frame) != size:
        raise WarcError("dictionary frame is cut short")
    decompressor = zstd.ZstdDecompressor(dict_data=_dictionary(frame))
    rest = b""
    while True:
        if not rest and not (rest := source.read(buffer)):
            return
        one, out = decompressor.decompressobj(), []
        while True:
            out.append(one.decompress(rest))
            if one.eof:
                rest = one.unused_data
                break
            if not (rest := source.read(buffer)):
                raise WarcError("last frame is cut short")
        yield b"".join(out)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one record, checked."""
    at = data.find(CRLF + CRLF)
    if at < 0:
        raise WarcError("header has no end")
    version, *lines = data[:at].split(CRLF)
    if version != VERSION:
        raise WarcError(f"version line {version[:20]!r}")
    fields: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.decode().partition(":")
        if not colon or not name or name in fields:
            raise WarcError(f"bad header line {line[:40]!r}")
        fields[name] = value.strip()
    if missing := [k for k in REQUIRED if k not in fields]:
        raise WarcError(f"no {missing[0]}")
    if not fields["Content-Length"].isdigit():
        raise WarcError("Content-Length is no number")
    n = int(fields["Content-Length"])
    if len(data) != at + 4 + n + 4 or not data.endswith(CRLF + CRLF):
        raise WarcError(f"record has {len(data) - at - 8} bytes of block, its header says {n}")
    block = data[at + 4 : at + 4 + n]
    if "WARC-Block-Digest" in fields and fields["WARC-Block-Digest"] != f"sha1:{digest(block)}":
        raise WarcError("block digest differs")
    return fields, block


def _urn(value: str) -> int | None:
    inner = value.removeprefix("<urn:page:").removesuffix(">")
    return None if inner == "null" else int(inner)


def read_record(data: bytes) -> dict:
    """page_id, url, payload (None for revisits), payload_bytes, payload_digest, record_type, refers_to."""
    fields, block = parse(data)
    at = block.find(CRLF + CRLF)
    if at < 0 or not block.startswith(b"HTTP/"):
        raise WarcError("block is no HTTP response")
    lengths = [int(x.split(b":")[1]) for x in block[:at].split(CRLF)[1:] if x.lower().startswith(b"content-length:")]
    kind, payload = fields["WARC-Type"], block[at + 4 :]
    said = fields.get("WARC-Payload-Digest", "").removeprefix("sha1:")
    if kind == "response":
        if lengths != [len(payload)]:
            raise WarcError("payload length differs from the HTTP header")
        if digest(payload) != said:
            raise WarcError("payload digest differs")
    elif kind != "revisit" or payload or len(lengths) != 1 or "WARC-Refers-To" not in fields:
        raise WarcError(f"bad {kind} record")
    return {
        "page_id": _urn(fields["WARC-Record-ID"]), "url": unescaped(fields["WARC-Target-URI"]) if "WARC-Target-URI" in fields else None, "payload": payload if kind == "response" else None, "payload_bytes": lengths[0],
        "payload_digest": said, "record_type": kind, "refers_to": _urn(fields["WARC-Refers-To"]) if kind == "revisit" else None,
    }


def write_archives(pages: DataFrame, out: str, *, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0, rotate: int = 256 << 20) -> DataFrame:
    """Write one record per row; returns the manifest (path, bytes, records), stored.

    Of rows with equal payloads of at least ``least`` bytes that with the smallest key is a
    response and the others revisit it (repeated rows of that key are responses too, and a
    null key never is the smallest; payloads that only rows of null keys have are responses).
    Archives of failed or repeated attempts are not in the manifest. Null or empty html is an empty payload, a null
    address no header line; a very long page is one record; an empty table gives an empty manifest; other columns are not used.
    """
    spark = pages.sparkSession
    out = common.qualified(spark, out)
    open_fs(out)[0].create_dir(open_fs(out)[1], recursive=True)
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    # Length and SHA-1 tell payloads apart as the records do; counting is combined before the shuffle.
    digests = rows.select("page_id", F.sha1(F.col("html").cast("binary")).alias("sha"), F.octet_length("html").alias("n"))
    firsts = digests.where(F.col("n") >= least).groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    firsts = common.stored(firsts, "warc-firsts")  # as a table of its own it lets Spark split a payload that very many rows share
    marked = rows.withColumn("sha", F.sha1(F.col("html").cast("binary"))).join(firsts, "sha", "left").withColumn(
        "refers_to", F.when((F.octet_length("html") >= least) & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = stream = path = None
        done: list[tuple[str, int, int]] = []
        for batch in batches:
            for i, u, h, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if writer is None:
                    path = f"{out}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.zst"
                    fs, at = open_fs(path)
                    stream = fs.open_output_stream(at, compression=None)
                    writer = ArchiveWriter(stream)
                writer.add(record(i, u, h.encode("utf-8", "surrogatepass"), first))
                if writer.size >= rotate:
                    done.append((path, writer.close(), writer.records))
                    stream.close()
                    writer = None
        if writer is not None:
            done.append((path, writer.close(), writer.records))
            stream.close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*done, strict=True)], names=["path", "bytes", "records"])

    return common.stored(marked.select("page_id", "url", "html", "refers_to").mapInArrow(write, "path string, bytes long, records long"), "warc-manifest")


def read_archives(manifest: DataFrame, *, payloads: bool = False) -> DataFrame:
    """The records of the archives in a manifest; with ``payloads`` their text too (null for revisits)."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([(n, t) for n, t in (("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())) if payloads or n != "payload"])
        for batch in batches:
            for f in batch.to_pylist():
                fs, at = open_fs(f["path"])
                rows, n = [], 0
                with fs.open_input_file(at) as source:
                    if source.size() != f["bytes"]:
                        raise WarcError(f"{f['path']} has {source.size()} bytes, not {f['bytes']}")
                    for data in read_frames(source):
                        rows.append(read_record(data))
                        n += 1
                        if len(rows) == 500:
                            yield pa.RecordBatch.from_pylist(rows, kinds)
                            rows = []
                if n != f["records"]:
                    raise WarcError(f"{f['path']} has {n} records, not {f['records']}")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kinds)

    return manifest.repartition(common.parts(manifest.sparkSession), "path").mapInArrow(read, schema)
