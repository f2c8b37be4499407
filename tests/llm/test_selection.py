"""Importance resampling, personal data and whitening against brute force, with nulls, empty, long, repeated and clashing input."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import disclosure, importance, queries, whitening

DOCS = "doc_id long, text string, chunk long, range int, row long, term string, place int, start long"


def table(spark, texts, ids=None):
    rows = [(i, t, 1, 2, 3, "x", 4, 5) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


# --- importance resampling ---


def plain_resampling(docs, bench):
    def features(text):
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    held = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in held for b in f), Counter(b for x in bench for b in features(x)[1])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (t_all + 10000) / ((s[b] + 1) * (s_all + 10000)))) for s_all, t_all in [(t.total(), s.total())] for b in s}
    rows = []
    for i, n, f in held:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        rows.append([i, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    order = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0]))
    drawn = Counter((r[0], r[2], r[4]) for r in order[: len(order) * 5 // 100])
    return rows, drawn, len(order) * 5 // 100


def texts_of(rng, n):
    pool = ["alpha", "Beta", "über", "x1", "9", "naïve", "日本", "ZETA", "q" * 70, "the"]
    return [" ".join(rng.choice(pool) for _ in range(rng.randrange(0, 60))) for _ in range(n)]


def test_resampling(spark, monkeypatch):
    rng = random.Random(3)
    texts = [*texts_of(rng, 150), None, "", "...", "a", "a B", "the " * 400, "w" * 300 + " " + "v" * 200 + ", é" * 30, *["copy of one text " * 9] * 40]
    ids = [*range(len(texts) - 2), 3, None]
    bench = ["alpha the copy of", "ÜBER über x1", None, ""]
    docs, target = table(spark, texts, ids), table(spark, bench)
    want, drawn, many = plain_resampling(list(zip(ids, texts, strict=True)), bench)

    def compare():
        got = importance.resample(docs, target)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and all(t == "bigint" for _, t in got.dtypes)
        rows = [tuple(r) for r in got.collect()]
        assert Counter(r[:4] for r in rows) == Counter((r[0], r[2], r[3], r[4]) for r in want)
        ranked = sorted((r for r in rows if r[4] is not None), key=lambda r: r[4])
        assert [r[4] for r in ranked] == list(range(1, many + 1)) and many > 5
        assert [r[3] for r in ranked] == sorted((r[3] for r in ranked), reverse=True)
        assert Counter((r[0], r[1], r[3]) for r in ranked) == drawn

    compare()
    monkeypatch.setattr(importance, "SLICE", 40)  # words and runs across slices
    texts_cut = [w for t in texts for part in importance.words_of(t or "") for w in part]
    monkeypatch.undo()
    assert texts_cut == [w for t in texts for part in importance.words_of(t or "") for w in part]


def test_chunks_cut_long_texts_without_losing_runs(monkeypatch):
    text = " ".join(random.Random(5).choice(["a", "bb", "ccc", "d" * 80]) for _ in range(3000))

    def packed():
        chunk = importance._Chunk(importance.Words(limit=2), 10000)
        chunk.add(1, text)
        chunk.add(2, "a bb")
        rows = list(chunk.rows(0))
        return rows[0]["n_features"], sorted((r["range"], *map(int, p)) for r in rows[1:] for p in zip(*importance.unpack(r["lengths"], r["docs"], r["counts"], r["more"]), strict=True))

    whole = packed()
    assert whole[0] == [3000 + 2999 + 2998, 3] and max(p[3] for p in whole[1]) > 255
    monkeypatch.setattr(importance, "SLICE", 500)
    monkeypatch.setattr(importance, "CHUNK_WORDS", 100)
    assert packed() == whole


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    some = table(spark, ["one two three " * 9] * 45)
    assert importance.resample(none, some).collect() == []
    assert sum(r["rank"] is not None for r in importance.resample(some, none).collect()) == 2


def test_resampling_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries.op11_importance_resampling(spark, sf)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, con.execute(queries.oracle_sql()["op11_importance_resampling"]).fetchall()))


# --- personal data ---

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_holds(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 8 <= len(d) <= 15


def plain_spans(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if plain_holds(k, m.group())]


TEXTS = [
    None, "", " ", "no data here", "a@b.c x.y@z-1.co.uk, a@b a@.c @b.c a@b..c 'q+r%s@t.u@v.w' a@b.c_d@e.f", "1.2.3.4 255.255.255.255 256.1.1.1 0001.02.3.4 1.2.3.4.5.6.7.8 1.2.3 .1.2.3.4 12.34.56.78.90",
    "4713332104704538 4713 3321-0470 4538 4713332104704539 4713  332104704538 47133321047045381234 1", "+1 (499) 555-6503 +49.30.1234567 +1234567 +1(2)3 +12345678901234567 ++44 20 7946 0958. +1 (499) 555-6503+1 499",
    "é\x01 mail: a@b.c\x02日本 +49 30 123456\x01 1.2.3.4 \U0001f600 x@y.z", "9" * 30000 + "." * 5, "a." * 20000 + "@b", "x@y.z " * 3000, "1 " * 5000, "+" * 5000 + "1", "a@b.c",
]


def test_base_spans_equal_plain_patterns(spark):
    rng = random.Random(11)
    texts = TEXTS + ["".join(rng.choice(["a", "7", "13", ".", "@", "+", " ", "-", "(", "x.y", "4713332104704538", "é", "\n", "10.0.0.1"]) for _ in range(rng.randrange(80))) for _ in range(400)]
    texts += [TEXTS[4], TEXTS[4]]
    ids = [*range(len(texts) - 2), 4, None]
    rows = Counter(tuple(r)[:6] for r in disclosure.digest(disclosure.find(table(spark, texts, ids), support=10**6)).collect())
    want = Counter()
    for i, t in zip(ids, texts, strict=True):
        spans = plain_spans(t)
        n = Counter(k for k, _, _ in spans)
        want[(i, *(n[k] for k in PLAIN), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest())] += 1
    assert rows == want


def plain_disclosures(texts, support, generalise):
    """(document, start, end) of the terms, by the definition."""
    counts, beside, pairs, at = Counter(), Counter(), {}, []
    for i, t in enumerate(texts):
        counts.update(re.findall(r"[^\W_]+", (t or "").lower()))
        seen = {}
        spans = plain_spans(t)
        for kind in PLAIN:
            raw = [m.span() for m in re.finditer(PLAIN[kind], t or "")]
            for k, a, b in spans:
                if k != kind:
                    continue
                n = raw.index((a, b))
                lo = max(raw[n - 1][1] if n else 0, a - disclosure.REACH)
                hi = min(raw[n + 1][0] if n + 1 < len(raw) else len(t), b + disclosure.REACH)
                entity = kind + ":" + (re.sub("[^0-9]", "", t[a:b]) if kind in ("card", "phone") else t[a:b].lower())
                left = [m.span() for m in re.finditer(r"[^\W_]+", t[lo:a]) if m.start() or a - lo < disclosure.REACH]
                right = [m.span() for m in re.finditer(r"[^\W_]+", t[b:hi]) if b + m.end() < hi or hi - b < disclosure.REACH]
                for p, q in [(lo + x, lo + y) for x, y in left[-disclosure.WINDOW :]] + [(b + x, b + y) for x, y in right[: disclosure.WINDOW]]:
                    if re.search(r"[^\W\d_]", t[p:q]):
                        seen.setdefault((p, q, entity), set()).add((t[lo:a], t[b:hi]))
        for (p, q, entity), contexts in seen.items():
            beside[entity] += 1
            pairs.setdefault((entity, t[p:q].lower()), []).append(min(contexts))
            at.append((i, p, q, entity))
    out, words = set(), counts.total()
    for i, p, q, entity in at:
        term = texts[i][p:q].lower()
        got = pairs[entity, term]
        ic = -math.log2(beside[entity] / words)
        share = (math.log2(min(1, len(got) / counts[term])) + ic) / ic
        if len(set(got)) >= support and share >= generalise and not any(a < q and p < b for _, a, b in plain_spans(texts[i])):
            out.add((i, p, q))
    return out


def test_terms_that_give_an_entity_away(spark):
    rng = random.Random(2)
    filler = ["oak", "elm", "fir", "ash", "yew", "sea", "sky"]
    some = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    texts = [f"{some(14)} Quillon {some(2)} jo@mail.example {some(12)}" for _ in range(6)] + [f"{some(30)}" for _ in range(40)]
    texts += [f"{some(5)} Once {some(1)} solo@mail.example {some(4)}"] * 50  # one surrounding, however often
    texts += [f"{some(8)} agent7 +49 30 1234567 {some(9)} 10.0.0.1 {some(3)}" for _ in range(5)] + [None, ""]
    got = disclosure.find(table(spark, texts)).collect()
    found = {(r["doc_id"], t["start"], t["end"]) for r in got for t in r["term"]}
    assert found == plain_disclosures(texts, 3, 0.9)
    words = {texts[i][a:b] for i, a, b in found}
    assert {"Quillon", "agent7"} <= words and "Once" not in words and not words & set(filler)
    clean = {r["doc_id"]: r["text"] for r in disclosure.sanitised(table(spark, texts)).collect()}
    assert all("Quillon" not in (t or "") and "jo@" not in (t or "") and "1234567" not in (t or "") for t in clean.values())
    assert clean[0] == re.sub(r"\s?Quillon", lambda m: " ", texts[0]).replace("jo@mail.example", "[email]") and all(clean[i] == texts[i] for i in range(6, 46))
    assert clean[len(texts) - 2] is None and clean[len(texts) - 1] == ""


def test_generalised_terms_get_a_class(spark):
    rng = random.Random(4)
    filler = lambda: " ".join(rng.choice(["oak", "elm", "fir", "ash"]) for _ in range(60))
    texts = [f"{filler()} Quillon jo@mail.example {filler()}" for _ in range(6)] + [f"{filler()} Quillon {filler()}" for _ in range(2)]
    clean = {r["doc_id"]: r["text"] for r in disclosure.sanitised(table(spark, texts), generalise=0.8).collect()}
    assert "[name] [email]" in clean[0] and clean[7] == texts[7]


def test_overlapping_spans_are_hidden_whole(spark):
    texts = ["call +49.10.20.30.40 now", "a@1.2.3.4", "x 1.2.3.4@b.c y"]
    got = [r["text"] for r in disclosure.sanitised(table(spark, texts)).orderBy("doc_id").collect()]
    assert got == ["call [phone] now", "[email]", "x [email] y"]


def test_no_texts(spark):
    none = spark.createDataFrame([], DOCS)
    assert disclosure.digest(disclosure.find(none)).collect() == [] and disclosure.sanitised(none).collect() == []


def test_personal_data_is_found_without_python(spark):
    plan = queries.op12_information_theoretic_pii(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- whitening ---

VECTORS = "vec_id long, embedding array<float>, v int, key string, c int, i int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2, 3) for i, v in rows], VECTORS).repartition(3)


def check_whitened(got, kept, most=32):
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in np.array(v, np.float32)] for _, v in kept]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    y = [[n * r[j] - s[j] for j in range(d)] for r in x]
    cov = np.array([[float(Fraction(sum(r[a] * r[b] for r in y), n**3)) for b in range(d)] for a in range(d)])
    values = np.sort(np.linalg.eigvalsh(cov))[::-1]
    k = min(most, int((values > 1e-12 * values[0]).sum()))
    assert len(got) == n * k and {r["n"] for r in got} == {n} and len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-6
    assert Counter((r["vec_id"], r["deviation"]) for r in got if r["component"] == 1) == Counter((i, sum(c * c for c in r)) for (i, _), r in zip(kept, y, strict=True))
    for c in range(1, k + 1):
        assert np.allclose({r["explained"] for r in got if r["component"] == c}.pop(), values[c - 1] / values.sum(), rtol=1e-6)
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {}).setdefault(r["component"], set()).add(r["whitened"])
    w = np.array([[min(by[i][c]) for c in range(1, k + 1)] for i, _ in kept])
    centred = np.array(y, float) / n
    basis = (centred.T @ w / n) / np.sqrt(values[:k])
    assert np.allclose(basis.T @ basis, np.eye(k), atol=1e-6) and np.allclose(cov @ basis, basis * values[:k], atol=1e-6 * values[0])
    assert np.allclose(centred @ basis / np.sqrt(values[:k]), w, atol=1e-6)


def test_whitening(spark):
    rng = np.random.default_rng(1)
    mix = rng.normal(size=(5, 5))
    good = [(i, [float(c) for c in (rng.normal(size=5) @ mix).astype(np.float32)]) for i in range(60)]
    good += [(3, good[3][1]), (None, good[4][1]), (61, [1000.0, -2000.0, 3.0, 0.0, 1.0])]
    bad = [(100, None), (101, [1.0, None, 2.0, 3.0, 4.0]), (102, [1.0, float("nan"), 2.0, 3.0, 4.0]), (103, [float("inf")] * 5), (104, []), (105, [1.0, 2.0])]
    check_whitened(whitening.whiten(vectors(spark, good + bad)).collect(), good)


def test_whitening_of_many_dimensions_keeps_the_first_components(spark):
    rng = np.random.default_rng(2)
    check_whitened(whitening.whiten(vectors(spark, [(i, [float(c) for c in rng.normal(size=40).astype(np.float32)]) for i in range(80)])).collect(), [(i, v) for i, v in enumerate(np.random.default_rng(2).normal(size=(80, 40)).astype(np.float32))])


def test_whitening_leaves_out_flat_components(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(a)), float(np.float32(a)), 5.0]) for i, a in enumerate(rng.normal(size=30))]
    got = whitening.whiten(vectors(spark, rows)).collect()
    assert {r["component"] for r in got} == {1} and got[0]["explained"] == pytest.approx(1) and got[0]["identity_error"] < 1e-9
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0])] * 3)).collect() == []
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).collect() == []


def test_large_entries_have_exact_sums(spark):
    rows = [(i, [(-1.0) ** i * 2.0**50, float(i)]) for i in range(8)]
    got = whitening.whiten(vectors(spark, rows)).collect()
    assert len(got) == 8 and {r["deviation"] for r in got} == {None} and got[0]["identity_error"] < 1e-4


def test_products_keep_what_doubles_lose():
    rng = np.random.default_rng(4)
    x = rng.integers(-(2**40), 2**40, (203, 4)) + 3
    total = whitening.Products(4)
    total.add(*whitening.centred(x, whitening.mean_parts(7, [1, -5, 9, 10**9])))
    mean = [Fraction(v, 7) for v in (1, -5, 9, 10**9)]
    for i, j, h, w in zip(total.i, total.j, total.high, total.low, strict=True):
        want = sum((int(r[i]) - mean[i]) * (int(r[j]) - mean[j]) for r in x)
        assert abs(Fraction(h) + Fraction(w) - want) <= abs(want) * Fraction(1, 2**95) + sum(abs(int(r[i])) * abs(int(r[j])) for r in x) * Fraction(1, 2**98)


def test_whitening_query_over_the_whole_table(spark):
    got = queries.op13_compensated_whitening(spark, "/root/testdata/sf0.001")
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert got.select("vec_id").distinct().count() == table.count() and got.agg(F.max("identity_error")).first()[0] < 1e-4
