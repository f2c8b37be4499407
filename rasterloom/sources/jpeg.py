"""Baseline JPEG for the tiles of TIFF files, with shared tables: 8 bits, Huffman coding, sampling factors 1 and 2.

Transforms and bit packing work on all blocks of a tile at once; only decoding of the bit stream goes symbol by symbol.
"""

from __future__ import annotations

import heapq
import struct
from dataclasses import dataclass, field

import numpy as np


def _zigzag() -> np.ndarray:
    """Places of an 8 x 8 block by diagonals, each run through the other way than the one before."""
    order = sorted(((u + v, u if (u + v) % 2 else v, u * 8 + v) for u in range(8) for v in range(8)))
    return np.array([k for _, _, k in order])


ZIGZAG = _zigzag()
_k = np.arange(8)
COSINES = np.sqrt(np.where(_k == 0, 1, 2) / 8)[:, None] * np.cos((2 * _k[None] + 1) * _k[:, None] * np.pi / 16)
START, END, TABLES, QUANT, FRAME, SCAN, INTERVAL = 0xD8, 0xD9, 0xC4, 0xDB, (0xC0, 0xC1), 0xDA, 0xDD


@dataclass
class Tables:
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    codes: dict[tuple[int, int], list[int]] = field(default_factory=dict)  # by 16 bits ahead: length << 8 | symbol; 0: none
    interval: int = 0


def _lookup(counts: bytes, symbols: bytes) -> list[int]:
    out, code, k = [0] * 65536, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            low = code << (16 - length)
            out[low : low + (1 << (16 - length))] = [length << 8 | symbols[k]] * (1 << (16 - length))
            code += 1
            k += 1
        code <<= 1
    return out


def _segments(data: bytes):
    """(marker, body, place behind it) up to the scan."""
    at = 0
    while at + 1 < len(data):
        if data[at] != 0xFF:
            raise ValueError("no JPEG marker where one is due")
        marker = data[at + 1]
        at += 2
        if marker in (START, 0xFF, 0x01):
            at -= marker == 0xFF
            continue
        if marker == END:
            return
        n = int.from_bytes(data[at : at + 2], "big")
        if n < 2 or at + n > len(data):
            raise ValueError("JPEG segment is cut short")
        yield marker, data[at + 2 : at + n], at + n
        at += n


def read_tables(data: bytes, tables: Tables) -> None:
    for marker, body, _ in _segments(data):
        _take(marker, body, tables)


def _take(marker: int, body: bytes, tables: Tables) -> None:
    at = 0
    if marker == QUANT:
        while at < len(body):
            wide, name = body[at] >> 4, body[at] & 15
            q = np.frombuffer(body, ">u2" if wide else "u1", 64, at + 1).astype(float)
            tables.quant[name] = np.zeros(64)
            tables.quant[name][ZIGZAG] = q
            at += 1 + 64 * (1 + (wide > 0))
    elif marker == TABLES:
        while at < len(body):
            counts = body[at + 1 : at + 17]
            n = sum(counts)
            tables.codes[body[at] >> 4, body[at] & 15] = _lookup(counts, body[at + 17 : at + 17 + n])
            at += 17 + n
    elif marker == INTERVAL:
        tables.interval = struct.unpack(">H", body[:2])[0]


def decode(data: bytes, shared: Tables | None = None) -> np.ndarray:
    """(height, width, components) of 8-bit samples as they were coded, without a change of colours."""
    tables = Tables(dict(shared.quant), dict(shared.codes), shared.interval) if shared else Tables()
    frame = None
    for marker, body, end in _segments(data):
        if marker in FRAME:
            if body[0] != 8:
                raise ValueError(f"JPEG of {body[0]} bits is not read")
            height, width, n = struct.unpack(">HHB", body[1:6])
            frame = {body[6 + 3 * k]: (body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)}
        elif marker == SCAN:
            if frame is None:
                raise ValueError("JPEG scan without a frame of the baseline kind")
            names = [(body[1 + 2 * k], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
            if len(names) != len(frame):
                raise ValueError("JPEG of several scans is not read")
            try:
                return _scan(data[end:], height, width, frame, names, tables)
            except (IndexError, KeyError) as e:
                raise ValueError("JPEG stream is cut short, or a table is missing") from e
        else:
            _take(marker, body, tables)
    raise ValueError("JPEG without a scan")


def _scan(data: bytes, height: int, width: int, frame: dict, names: list, tables: Tables) -> np.ndarray:
    hmax, vmax = max(h for h, _, _ in frame.values()), max(v for _, v, _ in frame.values())
    across, down = -(-width // (8 * hmax)), -(-height // (8 * vmax))
    if len(names) == 1:  # a single component is not interleaved
        across, down, hmax, vmax = -(-width // 8), -(-height // 8), 1, 1
        frame = {k: (1, 1, q) for k, (_, _, q) in frame.items()}
    blocks = {c: np.zeros((down * frame[c][1], across * frame[c][0], 64)) for c, _, _ in names}
    rows = {c: b.reshape(-1, 64) for c, b in blocks.items()}
    plan = []
    for c, dc, ac in names:
        h, v, _ = frame[c]
        plan += [(c, y, x, h, v, tables.codes[0, dc], tables.codes[1, ac]) for y in range(v) for x in range(h)]
    zigzag = ZIGZAG.tolist()
    # Restart markers cut the stream into parts that begin at a byte.
    parts, at = [], 0
    while True:
        k = data.find(b"\xff", at)
        while k >= 0 and (data[k + 1 : k + 2] == b"\0" or data[k + 1 : k + 2] == b"\xff"):
            k = data.find(b"\xff", k + (2 if data[k + 1 : k + 2] == b"\0" else 1))
        parts.append(data[at : k if k >= 0 else len(data)].replace(b"\xff\0", b"\xff"))
        if k < 0 or not 0xD0 <= (data[k + 1] if k + 1 < len(data) else 0) <= 0xD7:
            break
        at = k + 2
    unit, total = 0, across * down
    for part in parts:
        a = np.frombuffer(part + b"\xff" * 8, np.uint8).astype(np.uint32)
        ahead = (a[:-3] << 24 | a[1:-2] << 16 | a[2:-1] << 8 | a[3:]).tolist()
        last, p, limit = {c: 0 for c, _, _ in names}, 0, len(part) * 8
        for _ in range(min(tables.interval or total, total - unit)):
            my, mx = divmod(unit, across)
            for c, by, bx, h, v, dc, ac in plan:
                block = rows[c][(my * v + by) * across * h + mx * h + bx]
                entry = dc[ahead[p >> 3] >> (16 - (p & 7)) & 0xFFFF]
                n = entry & 255
                p += entry >> 8
                if n:
                    value = (ahead[p >> 3] << 8 | a[(p >> 3) + 4].item()) >> (40 - (p & 7) - n) & ((1 << n) - 1)
                    p += n
                    last[c] += value if value >> (n - 1) else value - (1 << n) + 1
                block[0] = last[c]
                k = 1
                while k < 64:
                    entry = ac[ahead[p >> 3] >> (16 - (p & 7)) & 0xFFFF]
                    if not entry:
                        raise ValueError("JPEG code that no table has")
                    p += entry >> 8
                    run, n = entry >> 4 & 15, entry & 15
                    if n == 0:
                        if run < 15:
                            break
                        k += 16
                        continue
                    k += run
                    value = (ahead[p >> 3] << 8 | a[(p >> 3) + 4].item()) >> (40 - (p & 7) - n) & ((1 << n) - 1)
                    p += n
                    if k > 63 or p > limit:
                        raise ValueError("JPEG stream is cut short")
                    block[zigzag[k]] = value if value >> (n - 1) else value - (1 << n) + 1
                    k += 1
            unit += 1
    if unit < total:
        raise ValueError("JPEG stream is cut short")
    out = np.empty((height, width, len(names)), np.uint8)
    for i, (c, _, _) in enumerate(names):
        h, v, q = frame[c]
        b = (blocks[c] * tables.quant[q]).reshape(*blocks[c].shape[:2], 8, 8)
        plane = np.einsum("ua,yxuv,vb->yaxb", COSINES, b, COSINES).reshape(b.shape[0] * 8, b.shape[1] * 8) + 128
        plane = np.repeat(np.repeat(plane, vmax // v, 0), hmax // h, 1)[:height, :width]
        out[:, :, i] = np.clip(np.rint(plane), 0, 255)
    return out


def from_ycc(a: np.ndarray) -> np.ndarray:
    """Red, green and blue of luminance and two differences."""
    y, b, r = (a[:, :, k].astype(float) for k in range(3))
    b, r = b - 128, r - 128
    return np.clip(np.rint(np.stack([y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b], 2)), 0, 255).astype(np.uint8)


# --- writing ---


def quantisation(quality: int) -> np.ndarray:
    """Steps that grow with the frequency: 2 to 20 at quality 90."""
    u, v = np.mgrid[0:8, 0:8]
    return np.clip(np.rint((2 + 1.3 * (u + v)) * (100 - quality) / 10), 1, 255).reshape(64)


def _lengths(freq: dict[int, int]) -> dict[int, int]:
    """Code lengths of at most 16 bits; a further, unused code keeps all ones free."""
    heap = [(n, [s]) for s, n in freq.items()] + [(0, [-1])]
    out = dict.fromkeys([*freq, -1], 0)
    heap = [(n, min(s), s) for n, s in heap]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            out[s] += 1
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
    order = sorted(out, key=lambda s: (min(out[s], 16), -freq.get(s, -1)))
    lengths = {s: max(1, min(out[s], 16)) for s in order}
    room = 65536 - sum(1 << (16 - n) for n in lengths.values())
    for s in reversed(order):  # what was cut to 16 bits is paid for by longer codes elsewhere
        while room < 0 and lengths[s] < 16:
            room += 1 << (15 - lengths[s])
            lengths[s] += 1
    # The unused code is the last of the longest.
    longest = max(lengths.values())
    other = next(s for s in lengths if lengths[s] == longest)
    lengths[other], lengths[-1] = lengths[-1], lengths[other]
    return lengths


def _table(kind: int, freq: dict[int, int]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """The segment's body and symbol -> (code, length)."""
    lengths = _lengths(freq)
    del lengths[-1]
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    counts = bytes(sum(n == k for n in lengths.values()) for k in range(1, 17))
    codes, code, before = {}, 0, 0
    for s in order:
        code <<= lengths[s] - before
        before = lengths[s]
        codes[s] = code, before
        code += 1
    return bytes([kind << 4]) + counts + bytes(order), codes


def _symbols(image: np.ndarray, quant: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(is of a block's first value, symbol, extra bits, their number) of an (h, w, n) image of whole blocks, in the order of the stream."""
    h, w, n = image.shape
    b = image.astype(float).reshape(h // 8, 8, w // 8, 8, n) - 128
    f = np.einsum("ua,yaxbn,vb->yxnuv", COSINES, b, COSINES).reshape(-1, n, 64)
    z = np.rint(f / quant).astype(np.int64)[:, :, ZIGZAG]
    z[:, :, 0] = np.diff(z[:, :, 0], axis=0, prepend=0)
    z = z.reshape(-1, 64)
    row, col = np.nonzero(z[:, 1:])
    col = col + 1
    before = np.where(np.r_[True, row[1:] != row[:-1]], 0, np.r_[0, col[:-1]]) if len(row) else col
    run = col - before - 1
    size = lambda v: np.ceil(np.log2(np.abs(v) + 1)).astype(np.int64)
    bits = lambda v, n: np.where(v < 0, v + (1 << n) - 1, v)
    first, value = z[:, 0], z[row, col]
    m = len(z)
    last = np.zeros(m, np.int64)
    np.maximum.at(last, row, col)
    ends = np.flatnonzero(last < 63)
    zrow = np.repeat(row, run >> 4)
    zcol = np.repeat(col, run >> 4)
    place = np.concatenate([np.arange(m) * 1000, row * 1000 + col * 10 + 5, zrow * 1000 + zcol * 10, ends * 1000 + 900])
    sym = np.concatenate([size(first), (run & 15) << 4 | size(value), np.full(len(zrow), 0xF0), np.zeros(len(ends), np.int64)])
    extra = np.concatenate([bits(first, size(first)), bits(value, size(value)), np.zeros(len(zrow) + len(ends), np.int64)])
    many = np.concatenate([size(first), size(value), np.zeros(len(zrow) + len(ends), np.int64)])
    order = np.argsort(place, kind="stable")
    return order < m, sym[order], extra[order], many[order]


def _packed(codes: np.ndarray, lengths: np.ndarray) -> bytes:
    """Bits of codes one after another, ones to the end of the last byte, stuffed."""
    n = int(lengths.sum())
    which = np.repeat(np.arange(len(lengths)), lengths)
    offset = np.arange(n) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    bits = (codes[which] >> (lengths[which] - 1 - offset) & 1).astype(np.uint8)
    return np.packbits(np.r_[bits, np.ones(-n % 8, np.uint8)]).tobytes().replace(b"\xff", b"\xff\0")


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body


def encode(tiles: list[np.ndarray], quality: int = 90) -> tuple[bytes, list[bytes]]:
    """Shared tables and a stream for each (h, w, n) tile of whole blocks; samples are coded as they are."""
    quant = quantisation(quality)
    parts = [_symbols(t, quant) for t in tiles]
    tables, codes = [], []
    for kind in (0, 1):
        found = np.concatenate([s[first == (kind == 0)] for first, s, _, _ in parts])
        values, counts = np.unique(found, return_counts=True)
        body, own = _table(kind, dict(zip(values.tolist(), counts.tolist(), strict=True)))
        tables.append(body)
        lookup = np.zeros((256, 2), np.int64)
        for s, c in own.items():
            lookup[s] = c
        codes.append(lookup)
    shared = bytes([0xFF, START]) + _segment(QUANT, b"\0" + quant[ZIGZAG].astype(np.uint8).tobytes()) + b"".join(_segment(TABLES, t) for t in tables) + bytes([0xFF, END])
    out = []
    for t, (first, sym, extra, many) in zip(tiles, parts, strict=True):
        h, w, n = t.shape
        code = np.where(first[:, None], codes[0][sym], codes[1][sym])
        stream = _packed(code[:, 0] << many | extra, code[:, 1] + many)
        frame = struct.pack(">BHHB", 8, h, w, n) + b"".join(bytes([k + 1, 0x11, 0]) for k in range(n))
        scan = bytes([n]) + b"".join(bytes([k + 1, 0]) for k in range(n)) + b"\0\x3f\0"
        out.append(bytes([0xFF, START]) + _segment(FRAME[0], frame) + _segment(SCAN, scan) + stream + bytes([0xFF, END]))
    return shared, out
