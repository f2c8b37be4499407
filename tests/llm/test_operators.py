"""Each operator against brute force, a round trip or held-out rows, with nulls, empty, long, repeated and clashing input."""

import hashlib
import io
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from rasterloom.llm import common, fingerprints, jaccard_join, packing, pfor, suffix_dedup, token_counts, toxicity, warc
from rasterloom.llm.tokens import CachedEncoder, default_tokenizer
from tokenizers import Tokenizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tkey string, key string, g int, doc string, spans int, run int"


def library():
    """As the library gives it, without any of this package's code or settings."""
    return Tokenizer.from_file(default_tokenizer())


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8))) for _ in range(n))


def table(spark, texts, ids=None):
    rows = [(i, t, "en", "s", len(t or ""), "x", "y", 1, "z", 2, 3) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(7)
    base = [words(rng, n) for n in (0, 1, 4, 5, 40, 80, 120, 200, 300)]
    texts = [*base, None, "", "   ", base[6], base[6], base[7], "\n".join([base[4]] * 30), "é" * 5000, words(rng, 9000)]
    near = base[8].split()
    for k in range(6):
        copy = list(near)
        copy[20 * k + 3] = "changed"
        texts.append(" ".join(copy))
    texts += ["one <|endoftext|> two", "three<|endoftext|>\n four"]
    texts += [words(rng, 60) + " " + base[5] + " " + words(rng, 50) for _ in range(4)]
    ids = [*range(len(texts) - 2), 3, None]
    return table(spark, texts, ids), list(zip(ids, texts, strict=True))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def key(row):
    return tuple((x is not None, x) for x in row)


# --- tokens, token files, packing ---


def test_cached_encoder_equals_the_library():
    encoder, rng = CachedEncoder(default_tokenizer(), limit=200), random.Random(1)
    own = library()
    for k in range(2000):
        t = "".join(rng.choice([chr(rng.randrange(256)), " ", "\n", "'s", "é", "a", "1", "  ", "\xa0", "œ" if rng.random() < 0.01 else "b"]) for _ in range(rng.randrange(30)))
        if k % 10 == 0:
            t = t[: k % 7] + " <|endoftext|>" + t[k % 7 :] + "<|endoftext"
        e = own.encode(t, add_special_tokens=False)
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == e.ids
        assert encoder.offsets(t).tolist() == [list(x) for x in e.offsets]


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_pfor_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 2**32, n, dtype=np.uint32), (rng.pareto(1, n) * 100).astype(np.uint32), np.full(n, 7, np.uint32)):
        data, starts = pfor.encode_blocks(ids)
        assert np.array_equal(pfor.decode_blocks(data, starts), ids)
        if len(starts) > 1:  # any block by its start
            assert np.array_equal(pfor.decode_blocks(data, starts[1:2]), ids[128:256])


def expected_ids(t, end):
    return np.array([*library().encode(t or "", add_special_tokens=False).ids, end], "<u4")


def test_token_files(spark, corpus, none):
    docs, rows = corpus
    manifest = pfor.write_token_files(docs, default_tokenizer(), common.scratch_path(spark, "t"), end_id=0)
    got = pfor.read_token_files(manifest, pfor.crc_row, "doc_id long, start long, n_tokens long, ids_crc32 long").collect()
    start, expected = 0, []
    order = {t: h for t, h in docs.select("text", F.xxhash64(F.coalesce("text", F.lit("")))).collect()}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, order[r[1]])):
        ids = expected_ids(t, 0)
        expected.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected
    empty = pfor.write_token_files(none, default_tokenizer(), common.scratch_path(spark, "t"))
    assert pfor.read_token_files(empty, pfor.crc_row, "doc_id long, start long, n_tokens long, ids_crc32 long").count() == 0


def test_token_files_of_few_ids(spark, corpus):
    """More files than ranges, and rows of one key in several of them, still follow one another."""
    docs, rows = corpus
    manifest = pfor.write_token_files(docs.unionByName(docs.withColumn("doc_id", F.lit(None).cast("long"))), default_tokenizer(), common.scratch_path(spark, "t"), end_id=0, rotate=400)
    got = sorted(pfor.read_token_files(manifest, pfor.crc_row, "doc_id long, start long, n_tokens long, ids_crc32 long").collect(), key=lambda r: r.start)
    assert manifest.count() > spark.conf.get("spark.sql.shuffle.partitions").__len__() and len(got) == 2 * len(rows)
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert keys == sorted(keys) and all(x.start + x.n_tokens == y.start for x, y in zip(got, got[1:], strict=False))
    assert Counter(r.ids_crc32 for r in got) == Counter(zlib.crc32(expected_ids(t, 0).tobytes()) for _, t in [*rows, *rows])


def test_other_vocabularies_go_to_the_library_whole():
    other = default_tokenizer().replace("byte_bpe_50k", "word_bpe_49k")
    encoder, own = CachedEncoder(other), Tokenizer.from_file(other)
    assert not encoder.pieces and CachedEncoder(default_tokenizer()).pieces
    for t in ("Hello  there, WORLD's 12", "a\nb <|endoftext|> c", ""):
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == own.encode(t, add_special_tokens=False).ids
        assert encoder.offsets(t).tolist() == [list(x) for x in own.encode(t, add_special_tokens=False).offsets]


def test_token_file_that_is_cut_short_is_refused(spark, corpus, tmp_path):
    import io

    stream = io.BytesIO()
    writer = pfor.TokenFileWriter(stream, 0)
    writer.add(1, np.arange(500, dtype="<u4").tobytes())
    size = writer.close()
    assert [(k, s, len(i)) for k, s, i in pfor.read_token_file(io.BytesIO(stream.getvalue()), size)] == [(1, 0, 501)]
    with pytest.raises(ValueError):
        list(pfor.read_token_file(io.BytesIO(stream.getvalue()[:-1]), size - 1))


def test_best_fit_decreasing_equals_one_by_one():
    rng = random.Random(3)
    for _ in range(150):
        capacity = rng.choice([10, 30, 100])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randrange(1, 120))]
        rooms = []
        for x in sorted(lengths, reverse=True):
            fit = [(r, i) for i, r in enumerate(rooms) if r >= x]
            if fit:
                rooms[min(fit)[1]] -= x
            else:
                rooms.append(capacity - x)
        filled: dict[int, int] = {}
        for length, _, n, first, offset in packing.best_fit_decreasing(Counter(lengths), capacity):
            for b in range(first, first + n):
                assert filled.get(b, 0) == offset
                filled[b] = offset + length
        assert sorted(capacity - v for v in filled.values()) == sorted(rooms)


def test_packing(spark, corpus, none):
    docs, rows = corpus
    got = packing.pack_documents(docs, default_tokenizer(), capacity=256).collect()
    by_sequence: dict[int, list] = {}
    pieces = Counter()
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    expected = Counter()
    for i, t in rows:
        ids = expected_ids(t, 2)
        edges = [0, *range(len(ids) % 256 or 256, len(ids) + 1, 256)]
        for p, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            expected[i, p, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert pieces == expected
    assert packing.pack_documents(none, default_tokenizer()).count() == 0


@pytest.mark.parametrize("setting", [4096, 100])
def test_texts_to_pack_are_read_by_few_rows(spark, corpus, tmp_path, monkeypatch, setting):
    docs, rows = corpus
    docs.write.parquet(f"{tmp_path}/docs")
    name, seen, stored = "spark.sql.parquet.columnarReaderBatchSize", [], common.stored
    monkeypatch.setattr(common, "stored", lambda df, label: seen.append(int(spark.conf.get(name))) or stored(df, label))
    before = spark.conf.get(name)
    spark.conf.set(name, setting)
    try:
        got = packing.pack_documents(spark.read.parquet(f"{tmp_path}/docs"), default_tokenizer())
        assert seen == [min(setting, common.READ_ROWS)] and int(spark.conf.get(name)) == setting
    finally:
        spark.conf.set(name, before)
    ids = Counter()
    for r in got.collect():
        ids[r.doc_id] += r.length
    expected = Counter()
    for i, t in rows:
        expected[i] += len(expected_ids(t, 2))
    assert ids == expected


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(spark, rule):
    text = "one two\n\nthree  \n four é\nfive"
    texts = [text, "", None, "x" * 3000 + "\n" + "y", "one <|endoftext|>\ntwo<|endoftext|>\n  three", text]
    got = {(r.doc_id, r.section): r for r in token_counts.attribute_sections(table(spark, texts), default_tokenizer(), rule=rule).collect()}
    own = library()
    for i, t in enumerate(texts):
        t = t or ""
        starts = token_counts.lines(t)
        ends = [*starts[1:], len(t)]
        expected = [0.0] * len(starts)
        for a, b in own.encode(t, add_special_tokens=False).offsets:
            share = [max(0, min(b, e) - max(a, s)) for s, e in zip(starts, ends, strict=True)]
            hit = [k for k, x in enumerate(share) if x]
            if rule == "split":
                for k in hit:
                    expected[k] += share[k] / (b - a)
            else:
                expected[hit[0] if rule == "first" else hit[-1] if rule == "last" else share.index(max(share))] += 1
        assert [got[i, k].n_tokens for k in range(len(starts))] == pytest.approx(expected)
        assert "".join(t[got[i, k].start : got[i, k].end] for k in range(len(starts))) == t


def test_token_counts_of_fields(spark):
    got = token_counts.attribute_fields(table(spark, ["hello there", None]), default_tokenizer(), ["lang", "source", "text"]).collect()
    assert sum(r.n_tokens for r in got if r.doc_id == 0) == len(library().encode("en\ns\nhello there", add_special_tokens=False).ids)
    assert {r.field: r.n_tokens for r in got if r.doc_id == 1}["text"] == 0
    own = library()
    docs = table(spark, ["a b", "a b", "", "word " * 50_000], [None, 3, 3, 3])
    for rule in token_counts.RULES:
        rows = token_counts.attribute_fields(docs, default_tokenizer(), ["text", "lang"], rule=rule).collect()
        assert len(rows) == 8 and sum(r.doc_id is None for r in rows) == 2
        totals = sorted(round(sum(r.n_tokens for r in pair), 6) for pair in zip(rows[::2], rows[1::2], strict=True))
        assert totals == sorted(len(own.encode(f"{t}\nen", add_special_tokens=False).ids) for t in ("a b", "a b", "", "word " * 50_000))


def test_token_counts_of_no_documents_and_of_a_long_one(spark, none):
    assert token_counts.attribute_sections(none, default_tokenizer()).collect() == [] == token_counts.attribute_fields(none, default_tokenizer(), ["text"]).collect()
    rng = random.Random(8)
    text = "\n".join(words(rng, 40) for _ in range(1500))
    got = token_counts.attribute_sections(table(spark, [text]), default_tokenizer()).collect()
    assert len(got) == 1500 and sum(r.n_tokens for r in got) == len(library().encode(text, add_special_tokens=False).ids)


# --- fingerprints ---


def generalised_jaccard(x, y):
    def bag(t):
        w = t.split()
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()

    a, b = bag(x), bag(y)
    keys = a.keys() | b.keys()
    return sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys) if keys else 1.0


def test_weighted_samples_collide_as_often_as_generalised_jaccard():
    rng, errors = np.random.default_rng(2), []
    for _ in range(200):
        terms = rng.integers(0, 2**63, 40).astype(np.uint64)
        a = rng.integers(1, 20, 40)
        b = np.maximum(1, a + rng.integers(-8, 8, 40))
        errors.append((fingerprints.sample_terms(terms, a) == fingerprints.sample_terms(terms, b)).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.06


def test_fingerprints_of_edits(spark, corpus, none):
    docs, rows = corpus
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in fingerprints.fingerprint_edits(docs).collect())
    order = [(i, t or "") for i, t in sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))]
    expected = Counter()
    for k, (i, t) in enumerate(order):
        edited = fingerprints.edited_text(t, order[(k + 1) % len(order)][1])
        expected[i, len(t), hashlib.sha256(edited.encode()).hexdigest()] += 1
    assert got == expected
    one = fingerprints.fingerprint_edits(table(spark, ["a b c d e f g h"])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert fingerprints.fingerprint_edits(none).count() == 0


def test_fingerprint_likeness(spark):
    rng = random.Random(5)
    a = words(rng, 200)
    rows = fingerprints.fingerprint_edits(table(spark, [a, a, words(rng, 150), "", None])).orderBy("doc_id").collect()
    assert rows[0].fingerprint == rows[1].fingerprint and rows[0].near_next == 1.0
    assert rows[1].near_next < 0.05 and rows[2].near_next == 0.0 and rows[3].near_next == 1.0
    for r, x, y in ((rows[0], a, a), (rows[1], a, None)):
        edited = fingerprints.edited_text(a, y) if y else None
        if edited:
            assert abs(r.near_edited - generalised_jaccard(x, edited)) < 0.15


# --- near copies ---


def shingles(t):
    w = (t or "").split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def alike(x, y):
    return not x and not y or bool(x | y) and len(x & y) >= 0.8 * len(x | y) - 1e-9


def brute_links(rows):
    sets = [shingles(t) for _, t in rows]
    near = [[j for j in range(len(rows)) if j != i and alike(sets[i], sets[j])] for i in range(len(rows))]
    group = list(range(len(rows)))
    for _ in rows:
        group = [min([group[i], *(group[j] for j in near[i])]) for i in range(len(rows))]
    return near, group


def test_jaccard_join(spark, corpus, none):
    docs, rows = corpus
    near, group = brute_links(rows)
    got = jaccard_join.jaccard_join(docs).collect()
    assert Counter((r.doc_id, r.n_links) for r in got) == Counter((i, len(n)) for (i, _), n in zip(rows, near, strict=True))
    assert len({r.class_id for r in got}) <= len(set(group)) and sum(r["first"] for r in got) == len(set(group))
    kept = jaccard_join.keep_one(docs).collect()
    assert len(kept) == len(set(group)) and kept[0].asDict().keys() == dict.fromkeys(docs.columns).keys()
    assert jaccard_join.jaccard_join(none).count() == 0 and jaccard_join.keep_one(none).count() == 0


def test_large_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CELL", 8)
    monkeypatch.setattr(jaccard_join, "SIGNATURE_CELL", 8)
    rng = random.Random(11)
    base = words(rng, 150).split()
    texts = [" ".join([*base[:k], "odd%d" % k, *base[k + 1 :]]) for k in range(5, 125, 3)]
    rows = list(enumerate(texts))
    near, group = brute_links(rows)
    got = {r.doc_id: r for r in jaccard_join.jaccard_join(table(spark, texts)).collect()}
    assert [got[i].n_links for i, _ in rows] == [len(n) for n in near]
    assert {r.class_id for r in got.values()} == {0} and set(group) == {0}


def test_recall_of_a_query_set_against_all_rows(spark):
    """Every id divisible by 50 with every row, by exact similarity: of the links at 0.8 or more, at least 0.9 are counted."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r.doc_id: shingles(r.text) for r in docs.select("doc_id", "text").collect()}
    holders: dict = {}
    for i, own in sets.items():
        for x in own:
            holders.setdefault(x, []).append(i)
    counted = {r.doc_id: r.n_links for r in jaccard_join.jaccard_join(docs).collect()}
    links = found = 0
    for i in (k for k in sets if k % 50 == 0):
        shared = Counter(j for x in sets[i] for j in holders[x] if j != i)
        true = sum(n >= 0.8 * (len(sets[i]) + len(sets[j]) - n) - 1e-9 for j, n in shared.items())
        assert counted[i] <= true or not sets[i]
        links, found = links + true, found + min(counted[i], true)
    assert found >= 0.9 * links


def loss(similarity, needed, hashes=130, step=13):
    """The probability that a pair of this similarity is dropped at one of the looks: a sum over the numbers of matches."""
    alive, lost = np.array([1.0]), 0.0
    look = np.array([math.comb(step, k) * similarity**k * (1 - similarity) ** (step - k) for k in range(step + 1)])
    for least in needed:
        alive = np.convolve(alive, look)
        lost += alive[:least].sum()
        alive[:least] = 0
    return lost


def test_pruning_loses_few_pairs_over_all_looks():
    assert loss(0.8, jaccard_join.least_matches(0.8, jaccard_join.TOLERANCE, 130, 13)) < 1e-4


def test_pruning_keeps_pairs_above_the_threshold():
    needed = jaccard_join.least_matches(0.8, 1e-4, 130, 13)
    assert (np.diff(needed) > 0).all() and needed[-1] < 0.8 * 130
    rng = np.random.default_rng(0)
    kept = sum(len(jaccard_join.surviving_pairs(np.stack([np.zeros(130, int), (rng.random(130) > 0.8).astype(int)]), np.array([0]), np.array([1]), needed, 13)) for _ in range(500))
    lost = sum(len(jaccard_join.surviving_pairs(np.stack([np.zeros(130, int), (rng.random(130) > 0.3).astype(int)]), np.array([0]), np.array([1]), needed, 13)) for _ in range(500))
    assert kept >= 498 and lost == 0


# --- repeated strings ---


def brute_repeats(texts):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + 200] for r in raw for i in range(len(r) - 199))
    out = []
    for r in raw:
        hit = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - 199):
            if seen[r[i : i + 200]] > 1:
                hit[i : i + 200] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8)))) == 1)
        out.append((len(r), int(hit.sum()), len(edges), hashlib.sha256(bytes(b for b, h in zip(r, hit, strict=False) if not h)).hexdigest()))
    return out


def repeats_corpus():
    rng = random.Random(2)
    passages = [words(rng, 60) for _ in range(3)]
    texts = ["a" * 900, "ab" * 300, "é" * 150 + words(rng, 30), None, "", passages[0][:199], passages[0][:200]]
    for _ in range(25):
        texts.append(" ".join(rng.choice([words(rng, 20), p[rng.randrange(40) : rng.randrange(230, 300)]]) for p in rng.sample(passages, 3)))
    return [*texts, texts[8], words(rng, 400) * 2]


@pytest.mark.parametrize("cap", [8192, 4])
def test_repeated_strings(spark, none, monkeypatch, cap):
    monkeypatch.setattr(suffix_dedup, "CAP", cap)  # 4: nearly all anchors are cut, down to single depths
    texts = repeats_corpus()
    ids = [*range(len(texts) - 1), None]
    got = suffix_dedup.digest_repeats(table(spark, texts, ids)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == Counter((i, *x) for i, x in zip(ids, brute_repeats(texts), strict=True))
    if cap > 4:
        assert suffix_dedup.digest_repeats(none).count() == 0
        kept = {r.doc_id: r for r in suffix_dedup.remove_repeats(table(spark, texts, ids)).collect()}
        assert kept[3].text is None and kept[4].text == "" and 0 not in kept and kept[5].text == texts[5]
        assert all(r.n_chars == len(r.text or "") for r in kept.values())


def test_repeated_rows_are_occurrences(spark):
    rng = random.Random(9)
    t = words(rng, 80)
    got = suffix_dedup.digest_repeats(table(spark, [t, t, words(rng, 80)], [4, 4, 5])).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_removed) for r in got] == [(4, len(t)), (4, len(t)), (5, 0)]


@pytest.mark.parametrize("same", [205, 230, 420])
def test_an_anchor_of_very_many_runs(spark, monkeypatch, same):
    """A passage in many different surroundings, and parts of it in others."""
    monkeypatch.setattr(suffix_dedup, "CAP", 8)
    rng = random.Random(5)
    passage = words(rng, 200)[:same]
    texts = [words(rng, 30) + passage + words(rng, 30) for _ in range(40)] + [words(rng, 30) + passage[k:] + words(rng, 25) for k in range(0, 60, 7)] + [words(rng, 20) + passage[:-k] + words(rng, 25) for k in range(1, 60, 7)]
    got = suffix_dedup.digest_repeats(table(spark, texts)).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == brute_repeats(texts)


def test_hashes_that_collide_are_seen(spark, monkeypatch):
    def weak(content, seed):
        return suffix_dedup.xxhash.xxh3_128_digest(content, seed=seed) if seed else bytes([content[0] % 3]) * 16

    monkeypatch.setattr(suffix_dedup, "content_hash", weak)
    texts = repeats_corpus()
    got = suffix_dedup.digest_repeats(table(spark, texts)).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == brute_repeats(texts)


def test_parts_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 700)
    texts = repeats_corpus()
    got = suffix_dedup.digest_repeats(table(spark, texts)).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == brute_repeats(texts)


def test_a_wrong_order_or_extension_is_seen():
    data = np.frombuffer(b"abcabdabcz", np.uint8)
    group, start, length = np.zeros(3, int), np.array([0, 3, 6]), np.array([3, 3, 4])
    suffixes = suffix_dedup.Suffixes(data, start, length)
    order, shared = suffixes.sort(group)
    assert suffixes.verify(order, shared)
    for bad_order, bad in ((order, [0, shared[1] - 1, shared[2]]), (order, [0, shared[1], shared[2] + 1]), (order[::-1], shared[::-1]), (order[[0, 2, 1]], [0, 2, 2])):
        assert not suffixes.verify(np.array(bad_order), np.array(bad))


def test_suffix_sort_equals_plain_sort():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    start = rng.integers(0, 3800, 300)
    length = rng.integers(0, 200, 300)
    group = np.sort(rng.integers(0, 12, 300))
    order, shared = suffix_dedup.classes_by_depth(data, start, length, group)
    plain, plain_shared = suffix_dedup.plain_sort(data, start, length, group)
    assert order.tolist() == plain.tolist() and shared.tolist() == plain_shared.tolist()


# --- archives ---


def test_archives(spark):
    rng = random.Random(4)
    long = words(rng, 30_000)
    html = [words(rng, 50), "", None, words(rng, 50), long, long, "é" * 99, "", long]
    ids = [5, 4, 3, 2, 1, 0, 9, None, 5]
    pages = spark.createDataFrame([(i, "http://x/\r\nA: b  c%5C20%5c \u2028é ", h, "z") for i, h in zip(ids, html, strict=True)], "page_id long, url string, html string, sha string")
    got = warc.read_archives(warc.write_archives(pages, common.scratch_path(spark, "w")), payloads=True).collect()
    least = {}
    for i, h in zip(ids, html, strict=True):
        if i is not None:
            least[h or ""] = min(i, least.get(h or "", 99))
    expected = Counter((i, len((h or "").encode()), warc.digest((h or "").encode()), None if least[h or ""] == i else least[h or ""]) for i, h in zip(ids, html, strict=True))
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.refers_to) for r in got) == expected
    assert {r.url for r in got} == {"http://x/\r\nA: b  c%5C20%5c \u2028é "}
    assert all(r.record_type == ("response" if r.refers_to is None else "revisit") for r in got)
    small = warc.read_archives(warc.write_archives(pages, common.scratch_path(spark, "w"), least=10)).collect()
    assert all(r.record_type == "response" for r in small if r.payload_bytes < 10)
    assert warc.read_archives(warc.write_archives(pages.limit(0), common.scratch_path(spark, "w"))).count() == 0


def test_damaged_records_are_refused():
    good = warc.record(1, "u", b"hello")
    assert warc.read_record(good)["payload"] == b"hello"
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"hello", b"jello"), good.replace(b"WARC-Date", b"WARC-Dote"), good.replace(b"Content-Length: 5\r", b"Content-Length: 6\r")):
        with pytest.raises(warc.WarcError):
            warc.read_record(bad)


def archive_of(payloads, sample=200):
    out = io.BytesIO()
    writer = warc.ArchiveWriter(out, sample=sample)
    for i, p in enumerate(payloads):
        writer.add(warc.record(i, "u", p))
    writer.close()
    return out.getvalue()


def test_damaged_archives_are_refused():
    payloads = [f"page {k} of some archive with words in it".encode() * 5 for k in range(20)]
    data = archive_of(payloads)
    assert [warc.read_record(r)["payload"] for r in warc.read_frames(io.BytesIO(data))] == payloads
    assert [warc.read_record(r)["payload"] for r in warc.read_frames(io.BytesIO(data), buffer=7)] == payloads
    size = int.from_bytes(data[4:8], "little")
    for bad, why in ((b"", "no dictionary"), (data[:5], "no dictionary"), (b"WARC" + data[4:], "magic"), (data[: 8 + size // 2], "dictionary frame is cut"), (data[:-3], "last frame is cut")):
        with pytest.raises(warc.WarcError, match=why):
            list(warc.read_frames(io.BytesIO(bad)))
    broken = bytearray(data)
    broken[8 + size + 30] ^= 0xFF  # within the first record's frame
    with pytest.raises((warc.WarcError, zstandard.ZstdError)):
        [warc.read_record(r) for r in warc.read_frames(io.BytesIO(bytes(broken)))]


def test_archives_that_differ_from_the_manifest_are_refused(spark, tmp_path):
    data = archive_of([b"one", b"two"])
    (tmp_path / "a.warc.zst").write_bytes(data)
    for size, records in ((len(data) + 1, 2), (len(data), 3)):
        manifest = spark.createDataFrame([(f"file://{tmp_path}/a.warc.zst", size, records)], "path string, bytes long, records long")
        with pytest.raises(Exception, match="not " + str(size if records == 2 else 3)):
            warc.read_archives(manifest).collect()


# --- toxicity ---


def test_toxicity_of_held_out_rows(spark, none):
    rng = random.Random(6)
    vocabulary = words(rng, 300).split()
    texts, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        t = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 60))]
        for _ in range(3 * toxic):
            t[rng.randrange(len(t))] = "zork" + rng.choice(["", "ing", "ed", "ster"])
        texts.append(" ".join(t))
        labels.append((i, int(toxic)))
    docs = table(spark, [*texts, "", None, "zorkster " * 2000], [*range(400), 1000, None, 1001])
    marks = spark.createDataFrame([*labels, (None, 1), (3, None), (5, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(400) if got[i].held_out]
    assert held == [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].predicted == labels[i][1] for i in held) >= 0.95 * len(held)
    assert got[1000].predicted == 0 and got[None].score == got[1000].score and got[1001].predicted == 1
    assert all(0 <= r.score <= 1 for r in got.values())
    assert toxicity.score(none, model).count() == 0
    assert {r.doc_id for r in toxicity.without_toxic(docs, model).collect()} == {i for i, r in got.items() if not r.predicted}


def test_toxicity_without_labels(spark, none):
    docs = table(spark, ["some words", None])
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.predicted for r in toxicity.score(docs, model).collect()} == {0}
    toxicity.train(none, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))


def shared_brute_force(counts):
    """Below each gram's full order, from whole tables in plain Python."""
    level, tables = dict(counts), []
    while level:
        tables.append(level)
        level = dict(Counter(g[1:] for g in level if len(g) > 1))
    flat = 1 / (len(tables[-1]) + 1)

    def probability(g, depth):
        if not g:
            return flat
        follow = [n for h, n in tables[depth].items() if h[:-1] == g[:-1]]
        return max(tables[depth][g] - toxicity.DISCOUNT, 0) / sum(follow) + toxicity.DISCOUNT * len(follow) / sum(follow) * probability(g[1:], depth + 1)

    return {g: probability(g[1:], 1) for g in counts}


@pytest.mark.parametrize("texts", [["abba baba", "aé abbé", "x 😀a", "cab abba", None], ["a", "b"], [""]])
def test_shared_model_equals_brute_force(spark, texts):
    counts = toxicity.count_grams(Counter(w for t in texts for w in (t or "").split()))
    rows = [(g, n, i % 3 == 1, i % 3 == 2) for i, (g, n) in enumerate(counts.items())]
    grams = spark.createDataFrame([(g, n, int(a), int(b)) for g, n, a, b in rows], "gram string, n long, toxic long, ordinary long")
    got = {r.gram: r.below for r in toxicity.shared_model(grams).collect()}
    expected = shared_brute_force(counts) if counts else {}
    assert set(got) == {g for g, _, a, b in rows if a or b}
    assert got == pytest.approx({g: expected[g] for g in got})


def test_rare_grams_keep_their_class_counts(spark):
    """A gram of one occurrence among more than 2 / 5e-7 others."""
    docs = table(spark, ["common words here " * 30_000] * 10 + ["zqx", "common"], [*range(100, 110), 1, 2])
    keys = [k for k in range(1000) if zlib.crc32(str(k).encode()) % 5 not in (0, 4)][:2]
    docs = docs.replace({1: keys[0], 2: keys[1]}, subset=["doc_id"])
    marks = spark.createDataFrame([(keys[0], 1), (keys[1], 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    assert {"^z", "^zq", "^zqx", "^zqx$"} <= set(model.seen) and model.word("zqx") > model.word("common")


def direct_ratio(word, shared, own):
    """ln P(word | toxic) - ln P(word | ordinary) from tables of counts: absolute discounts that back off to the shared model's probability, gram by gram."""
    total = 0.0
    for g in toxicity.grams(word):
        p = []
        for counts in own:
            context = sum(n for h, n in counts.items() if h[:-1] == g[:-1])
            types = sum(h[:-1] == g[:-1] for h in counts)
            p.append(shared(g) if not context else max(counts.get(g, 0) - toxicity.DISCOUNT, 0) / context + toxicity.DISCOUNT * types / context * shared(g))
        total += np.log(p[0]) - np.log(p[1])
    return total


def test_scores_equal_a_direct_kneser_ney_model(spark):
    rng = random.Random(8)
    vocabulary = words(rng, 40).split()
    texts = [" ".join(rng.choice(vocabulary) + ("zork" if i % 3 == 0 and rng.random() < 0.3 else "") for _ in range(12)) for i in range(60)]
    docs = table(spark, texts)
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    every = toxicity.count_grams(Counter(w for t in texts for w in t.split()))
    own = [toxicity.count_grams(Counter(w for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 not in (0, 4) and (i % 3 == 0) == side for w in t.split())) for side in (True, False)]
    below = shared_brute_force(every)
    probe = texts[0].split() + texts[1].split()
    expected = {w: direct_ratio(w, below.__getitem__, own) for w in probe}
    assert {w: model.word(w) for w in probe} == pytest.approx(expected, abs=1e-9)
    for t in texts[:6]:
        ratios = np.array([direct_ratio(w, below.__getitem__, own) for w in t.split()])
        normalised = np.maximum(np.log(1 - toxicity.SHARE), np.log(toxicity.SHARE) + ratios).mean()
        assert toxicity.Evidence(model).of(t) == pytest.approx(np.log1p((normalised - np.log(1 - toxicity.SHARE)) / toxicity.SCALE))


def test_labels_may_have_names_of_documents(spark):
    docs = table(spark, ["good words", "zork zork", None]).withColumn("toxic", F.lit(9)).withColumn("label", F.lit(1))
    model = toxicity.train(docs, spark.createDataFrame([(0, 0, "x"), (1, 1, "y")], "doc_id long, toxic int, text string"))
    assert toxicity.score(docs, model).count() == 3 and toxicity.without_toxic(docs, model).columns == docs.columns


def test_tables_are_stored_by_small_batches(spark):
    import pyarrow as pa

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    got = [r.n for r in common.stored(spark.range(0, 3500, 1, 1).mapInArrow(sizes, "n long"), "sizes").collect()]
    assert max(got) <= 1000 and sum(got) == 3500 and spark.conf.get(name) == before


def test_anchors_take_little_memory_at_once():
    import tracemalloc

    rng = np.random.default_rng(0)
    texts = [rng.integers(32, 127, 5000, np.uint8).tobytes() for _ in range(300)]
    tracemalloc.start()
    for data, starts, _ in suffix_dedup._chunks(texts):
        suffix_dedup.runs_of(data, starts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6


def shuffle_files(spark):
    """Size of each shuffle file on disk, by name."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    files = [files.apply(i) for i in range(files.size())]
    return {f.getName(): f.length() for f in files if f.getName().startswith("shuffle_") and f.getName().endswith(".data")}


def test_repeats_leave_no_shuffles_and_only_spans(spark, monkeypatch):
    import time
    from pathlib import Path
    from urllib.parse import urlparse

    stored, before, left = common.stored, set(shuffle_files(spark)), []

    def watched(df, label):
        got, end = stored(df, label), time.time() + 3
        while set(shuffle_files(spark)) - before and time.time() < end:
            time.sleep(0.1)
        left.append(set(shuffle_files(spark)) - before)
        return got

    monkeypatch.setattr(common, "stored", watched)
    monkeypatch.setattr(suffix_dedup, "CAP", 8)
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held = spark.conf.get(name)
    with common.scratch_scope([]) as paths:
        suffix_dedup.digest_repeats(table(spark, repeats_corpus()))
    assert len(left) > 6 and not any(left) and spark.conf.get(name) == held
    assert [Path(p).name.split("-")[0] for p in paths if Path(urlparse(p).path).exists()] == ["spans"]


def test_contents_are_shuffled_once(spark, monkeypatch):
    import contextlib

    monkeypatch.setattr(common, "short_lived_shuffles", lambda spark: contextlib.nullcontext(), raising=False)
    rng = np.random.default_rng(3)
    texts = [rng.integers(48, 123, 4000, np.uint8).tobytes().decode() for _ in range(60)]
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, -1)
    try:
        docs = table(spark, texts * 2)
        runs = suffix_dedup.run_contents(suffix_dedup._rows(docs, "doc_id", "text"))
        counts = common.stored(runs.groupBy("mh", "hi", "lo").agg(F.count(F.lit(1)).alias("n")), "run-counts")
        written = []
        for job in (lambda: runs.where("content is not null").repartition(4, "mh").write.format("noop").mode("overwrite").save(), lambda: common.stored(suffix_dedup.compared_runs(runs, counts), "found")):
            old = set(shuffle_files(spark))
            job()
            written.append(sum(n for f, n in shuffle_files(spark).items() if f not in old))
    finally:
        spark.conf.set(name, before)
    assert 0 < written[0] and written[1] < 1.6 * written[0]


def test_copies_of_an_anchor_of_one_run_are_compared(spark):
    """Rows of one run whose bytes differ mark its hash, beside a group of two runs."""
    def piece(g, hi, content):
        return g, hi, 0, 5, 0, suffix_dedup.WIDTH - 1, content

    a, b = bytes(range(210)), bytes(range(1, 211))
    rows = [piece(1, 1, a), piece(1, 1, a), piece(1, 1, b), piece(2, 2, a), piece(2, 2, a), piece(3, 3, a), piece(3, 4, a), piece(3, 3, None), piece(4, 5, b)]
    got = suffix_dedup._sorted_groups(spark.createDataFrame(rows, suffix_dedup._PIECE), marked=True).collect()
    assert sorted((r.hi, r.strings) for r in got) == [(1, [-1]), (3, [0, 6])]
