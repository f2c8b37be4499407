"""The pipeline over a small planted corpus: every stage's rows, and those of run(), against plain Python."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_leaks import ITEM, brute_force
from test_operators import brute_links, expected_ids, words

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BENCHMARK = [(1, ITEM), (2, None), (3, "Who wrote Hamlet")]


def documents():
    rng = random.Random(21)
    clean = [words(rng, rng.randrange(30, 60)) for _ in range(60)]
    toxic = [" ".join("zork" + rng.choice(["", "ing", "ed"]) if k % 7 == 0 else w for k, w in enumerate(words(rng, 40).split())) for _ in range(30)]
    passage = words(rng, 70)
    near = words(rng, 200).split()
    texts = [*clean, *toxic]
    texts += [" ".join([*near[:k], "other", *near[k + 1 :]]) for k in (10, 60, 120)] + [clean[3], clean[3]]
    texts += [f"{words(rng, 30)} {passage} {words(rng, 40)}" for _ in range(3)] + [passage]
    texts += [f"{words(rng, 20)} {ITEM} {words(rng, 9)}", ITEM.replace("Tom", "Max").replace("3", "8"), f"and who wrote hamlet {words(rng, 12)}"]
    texts += [None, "", "  ", "é" * 400, " ".join(words(rng, 1)[:2] + str(k) for k in range(4000))]
    ids = [*range(len(texts) - 1), None]
    return list(zip(ids, texts, strict=True))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rows = documents()
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    df.repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int("zork" in t)) for i, t in rows[:90]], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(BENCHMARK, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def without_repeats(rows):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(r[i : i + 200] for r in raw for i in range(len(r) - 199))
    out = []
    for (k, t), r in zip(rows, raw, strict=True):
        hit = np.zeros(len(r), bool)
        for i in range(len(r) - 199):
            if seen[r[i : i + 200]] > 1:
                hit[i : i + 200] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
        parts = np.split(np.frombuffer(r, np.uint8), edges)
        new = t if not hit.any() else "".join(p.tobytes().decode("utf-8", "ignore") for p in parts[::2])
        if not (t or "").strip() or (new or "").strip():
            out.append((k, new))
    return out


def pieces(rows, capacity=1024):
    out = Counter()
    for i, t in rows:
        ids = expected_ids(t, 2)
        edges = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
        for p, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            out[i, p, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    return out


def same(got, expected):
    assert Counter((r.doc_id, r.text) for r in got) == Counter(expected)
    assert all(r.lang == "en" and r.source == "s" and r.n_chars == len(r.text or "") for r in got)


def test_every_stage(spark, tables, tmp_path):
    rows, done = documents(), []
    df = spark.read.parquet(f"{tables}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        columns = df.columns
        stage(spark, df, tables).write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
        got = df.collect()
        done.append(name)
        if name == "toxicity":
            rows = [r for r in rows if "zork" not in (r[1] or "")]
        elif name == "ngram_jaccard_join":
            _, group = brute_links(rows)
            first = {}
            for (i, t), g in zip(rows, group, strict=True):
                first.setdefault(g, []).append((i is not None, i or 0, i, t))
            rows = [min(members, key=lambda m: m[:2])[2:] for members in first.values()]
        elif name == "suffix_array_dedup":
            rows = without_repeats(rows)
        elif name == "benchmark_decontamination":
            leaked = {d for d, _ in brute_force([t for _, t in rows], BENCHMARK)}
            assert len(leaked) == 3
            rows = [r for k, r in enumerate(rows) if k not in leaked]
        else:
            assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == pieces(rows)
            continue
        same(got, rows)
        assert df.columns == columns
    assert done == ["toxicity", "ngram_jaccard_join", "suffix_array_dedup", "benchmark_decontamination", "best_fit_packing"]
    first = corpus_pipeline.run(spark, tables)
    for _, stage in corpus_pipeline.STAGES[:2]:  # what a later run deletes is its own, so the first can still be read
        stage(spark, spark.read.parquet(f"{tables}/documents.parquet").limit(5), tables)
    got = first.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == pieces(rows)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_extra_columns_and_empty_tables(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet").where("doc_id >= 70 or doc_id is null").withColumns({c: F.lit(5) for c in ("toxic", "h", "tkey", "spans", "cls", "row")})
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, tables).write.parquet(f"{tmp_path}/w{k}")
        new = spark.read.parquet(f"{tmp_path}/w{k}")
        assert new.columns == docs.columns
        docs = new
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs.limit(0), tables).write.parquet(f"{tmp_path}/e{k}")
        assert spark.read.parquet(f"{tmp_path}/e{k}").count() == 0
