"""Token ids and offsets of whole texts, from the tokenizers library.

A byte-level BPE never merges across the pieces into which its pattern cuts a
text, so a text's ids are those of its pieces, one after another. Pieces repeat;
their ids are taken from the library once and kept. Texts with characters
outside Latin-1, where Unicode tables of two libraries might differ, and texts
with the string of an added token, which the library finds before it cuts, go to
the library whole. So does everything for a vocabulary that is not of this kind:
one with another pattern, a normalizer or a post-processor that joins pieces.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

#: The vocabulary's pattern with the letters, digits and spaces of Latin-1 spelt out.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", r"\t-\r \x85\xa0"
PIECES = re.compile(rf" ?[{_L}]+| ?[{_N}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Pieces whose ids a Python worker keeps, about 250 MB.
KEPT = 900_000


def cuts_like_pieces(path: str) -> bool:
    """Whether PIECES cuts as this tokenizer does, so that ids of pieces are ids of the text."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    before, model = said.get("pre_tokenizer") or {}, said.get("model") or {}
    byte_level = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    after = (said.get("post_processor") or {}).get("type", "ByteLevel") == "ByteLevel" and not (said.get("post_processor") or {}).get("trim_offsets")
    return bool(byte_level and model.get("type") == "BPE" and plain and after and not any(said.get(k) for k in ("normalizer", "truncation", "padding")))


class CachedEncoder:
    """Ids as little-endian uint32 bytes; offsets as int32 pairs (start, end) of characters.

    Both are what ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)`` gives.
    """

    def __init__(self, path: str, limit: int = KEPT):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.pieces = cuts_like_pieces(path)
        line_feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.pieces = self.pieces and len(line_feed) == 1
        self.line_feed = line_feed[0] if self.pieces else None
        self.limit = limit
        self.ids: dict[str, bytes] = {}
        self.spans: dict[str, bytes] = {}

    def _plain(self, text: str) -> bool:
        if not self.pieces or self.added is not None and self.added.search(text):
            return False
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return True

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; pieces not met before go to the library together."""
        cache = self.ids
        if len(cache) > self.limit:
            cache.clear()
        cut = [PIECES.findall(t) if self._plain(t) else None for t in texts]
        new = list({p for pieces in cut if pieces for p in pieces if p not in cache})
        words = [p for p in new if p[-1].isalpha() and p[0] != "'"]
        rest = [p for p in new if not (p[-1].isalpha() and p[0] != "'")]
        if words:  # one call: a line feed never joins a word's piece, and no word holds its id
            ids = np.asarray(self.tokenizer.encode_batch_fast(["\n".join(words)], add_special_tokens=False)[0].ids, "<u4")
            ends = [*np.flatnonzero(ids == self.line_feed).tolist(), len(ids)]
            whole, at = ids.tobytes(), 0
            for p, end in zip(words, ends, strict=True):
                cache[p] = whole[4 * at : 4 * end]
                at = end + 1
        for p, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            cache[p] = array("I", e.ids).tobytes()
        get = cache.__getitem__
        return [array("I", self.tokenizer.encode(t, add_special_tokens=False).ids).tobytes() if pieces is None else b"".join(map(get, pieces)) for t, pieces in zip(texts, cut, strict=True)]

    def offsets(self, text: str) -> np.ndarray:
        """(n, 2) character spans of the tokens, as the library gives them for the whole text."""
        if not self._plain(text):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).offsets, np.int32).reshape(-1, 2)
        pieces, cache = PIECES.findall(text), self.spans
        if any(p not in cache for p in pieces):
            if len(cache) > self.limit:
                cache.clear()
            new = [p for p in dict.fromkeys(pieces) if p not in cache]
            for p, e in zip(new, self.tokenizer.encode_batch(new, add_special_tokens=False), strict=True):
                cache[p] = np.asarray(e.offsets, np.int32).tobytes()
        if not pieces:
            return np.empty((0, 2), np.int32)
        found = [cache[p] for p in pieces]
        counts = np.fromiter((len(b) // 8 for b in found), np.int64, len(found))
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        starts = np.concatenate(([0], ends[:-1])).astype(np.int32)
        spans = np.frombuffer(b"".join(found), np.int32).reshape(-1, 2)
        return spans + np.repeat(starts, counts)[:, None]


_encoders: dict[tuple[str, int], CachedEncoder] = {}


def encoder(path: str, limit: int = KEPT) -> CachedEncoder:
    """One per path and Python worker."""
    if (path, limit) not in _encoders:
        _encoders[path, limit] = CachedEncoder(path, limit)
    return _encoders[path, limit]
