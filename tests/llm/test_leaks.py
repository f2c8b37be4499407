"""Template decontamination against brute force: every window of an item with every window of a document, slot by slot."""

import random
import time

import numpy as np
import pytest

from rasterloom.llm import decontamination

DOCS = "doc_id long, text string, item_id int, tkey string, row int, h string"
ITEM = "On Monday the farmer Tom has 3 apples and buys 12 kg of pears from Ann. Then Tom sells 3 apples to Bob for 5 dollars each."


def table(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, 1, "x", 2, "y") for i, t in zip(ids or range(len(texts)), texts, strict=True)], DOCS).repartition(3)


def items(spark, rows):
    return spark.createDataFrame([(k, t, 1) for k, t in rows], "item_id long, text string, doc_id int")


def found(spark, texts, rows):
    return {(r.doc_id, r.item_id): r for r in decontamination.find_leaks(table(spark, texts), items(spark, rows)).collect()}


def test_leaks(spark):
    benchmark = items(spark, [(7, ITEM), (8, None), (9, ""), (10, "too short")])
    texts = [
        f"Some words before. {ITEM} And after.", "nothing of this kind is in here at all", None, "", ITEM.replace("Tom", "Max").replace("3", "7").replace("Bob", "Jim"),
        "On Monday the farmer Max has 7 apples then other things follow that are not in it", ITEM.lower(), "On Friday the farmer Max has 3 apples and Eve buys 4 pears from him and Max sells them.",
        "word " * 60_000 + ITEM + " word" * 60_000,
    ]
    got = {r.doc_id: r for r in decontamination.find_leaks(table(spark, texts), benchmark).collect()}
    assert set(got) == {0, 4, 6, 8} and {r.item_id for r in got.values()} == {7}
    assert {k: (r.coverage, r.changed) for k, r in got.items()} == {0: (1.0, False), 4: (1.0, True), 6: (1.0, False), 8: (1.0, False)}
    kept = decontamination.without_leaks(table(spark, texts), benchmark)
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - set(got) and kept.columns == table(spark, texts).columns


def test_empty_tables_nulls_and_repeated_rows(spark):
    none = table(spark, []).limit(0)
    assert decontamination.find_leaks(none, items(spark, [(1, ITEM)])).count() == 0 and decontamination.without_leaks(none, items(spark, [(1, ITEM)])).count() == 0
    assert decontamination.find_leaks(table(spark, [ITEM]), items(spark, [(1, ITEM)]).limit(0)).count() == 0
    assert decontamination.without_leaks(table(spark, [ITEM]), items(spark, [(1, ITEM)]).limit(0)).count() == 1
    docs = table(spark, [ITEM, ITEM, ITEM, "other", "other", None, None], [None, 4, 4, 4, 4, None, None])
    got = decontamination.find_leaks(docs, items(spark, [(None, ITEM), (5, ITEM), (5, ITEM), (6, ITEM + " And more words.")])).collect()
    assert sorted((r.doc_id or 0, r.item_id or 0, r.n_items) for r in got) == sorted((d, k, 3) for d in (0, 4, 4) for k in (0, 5, 6))
    assert {(r.item_id or 0, r.coverage < 1) for r in got} == {(0, False), (5, False), (6, True)}
    assert sorted((r.doc_id or 0, r.text or "") for r in decontamination.without_leaks(docs, items(spark, [(1, ITEM)])).collect()) == [(0, ""), (0, ""), (4, "other"), (4, "other")]


def test_slots_must_be_consistent(spark):
    item = "the Tom gave 3 apples to girl Ann and Tom took 3 back"  # 13 tokens
    texts = [
        item.replace("Tom", "Max").replace("3", "9"), item.replace("Tom gave", "Max gave"), item.replace("3 apples", "4 apples"),  # one value meets two
        item.replace("Ann", "Tom"), item.replace("Tom", "Ann"),  # two values meet one
    ]
    assert {k for k, _ in found(spark, texts, [(1, item)])} == {0}


def test_leaks_in_other_capitals_and_of_few_literals(spark):
    strasse = "On Monday the farmer Tom went along the long Kantstraße to sell 3 apples and 12 pears to Bob there."
    rows = [(7, ITEM), (11, "What is 12 times 15?"), (12, "Ann likes Bob"), (13, "12 kg"), (14, "In 3 km"), (15, strasse), (16, "?!"), (17, "Who wrote Hamlet")]
    texts = [
        ITEM.lower(), ITEM.upper(), f"before {ITEM.upper()} after", ITEM.upper().replace("3", "7"), "So what is 12 times 15? Nobody knows", "What is 12 times 16?", "WHAT IS 12 TIMES 15",
        "but ann likes bob a lot", "Eve likes Bob", "Take 12 KG of it", "Take 13 kg of it", "5 in 3 km", strasse.upper(), "?!", "who wrote hamlet?", "Who wrote Faust",
    ]
    got = {k: (r.coverage, r.changed) for k, r in found(spark, texts, rows).items()}
    assert got.pop((3, 7)) == (1.0, True)
    assert got.pop((5, 11)) == (1.0, True)  # a sentence of its own
    exact = {(0, 7), (1, 7), (2, 7), (4, 11), (6, 11), (7, 12), (9, 13), (11, 14), (12, 15), (14, 17)} | {(k, 13) for k in (0, 1, 2, 3)}
    assert got == dict.fromkeys(exact, (1.0, False))


def test_very_many_items_of_one_template(spark):
    """They are one class, so a document full of the template costs rows in proportion to its length."""
    rows = [(k, f"a farmer named Tom{'abcdefghij'[k % 10]} sold {k} red apples to the tall woman called Ann on that day") for k in range(3000)]
    text = " . ".join(rows[k][1] for k in range(0, 1000, 5)) + " . " + rows[1][1].replace("sold 1 ", "sold 9999 ")
    began = time.time()
    index = decontamination.benchmark_windows(items(spark, rows))
    hits = decontamination.window_hits(table(spark, [text]), index)
    n = hits.count()
    assert n < 3 * len(text.split()) and time.time() - began < 20
    got = decontamination.find_leaks(table(spark, [text]), items(spark, rows)).collect()
    assert sum(not r.changed for r in got) == 200 and max(r.n_items for r in got) == 3000
    classes = {c for r in got for c in r.classes}
    listed = decontamination.members(items(spark, rows)).collect()
    assert classes and {r.item_id for r in listed if r["class"] in classes} == set(range(3000))


def test_items_that_share_windows_are_each_told(spark):
    rng = random.Random(1)
    word = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    own, shared = word(20), word(30)
    got = found(spark, [f"before {shared} after", f"{own} {shared}", own], [(1, f"{own} {shared}"), (2, shared), (3, f"{shared} {word(5)}")])
    assert {k: round(r.coverage, 6) for k, r in got.items()} == {(0, 1): 0.6, (0, 2): 1.0, (0, 3): round(30 / 35, 6), (1, 1): 1.0, (1, 2): 1.0, (1, 3): round(30 / 35, 6), (2, 1): 0.4}
    assert all(r.classes == [] for r in got.values()) and decontamination.members(items(spark, [(1, own)])).count() == 0


def test_a_short_item_with_other_values_is_a_sentence(spark):
    texts = ["What is 7 times 9?", "Tell me. What is 7 times 9? Now.", "He asks what is 7 times 9 and leaves", "What is 7 times nine?", "Where is 7 times 9?", "What is 7 times 7?"]
    assert {k for k, _ in found(spark, texts, [(1, "What is 12 times 15?")])} == {0, 1}


def brute_force(texts, rows):
    """Pairs (document, item) with a consistent window, from tokens and slots written out."""

    def reading(text):
        out, before_end, before_number = [], True, False
        for w in decontamination.TOKENS.findall(text or ""):
            if not (w[0].isalpha() or w[0].isdigit()):
                before_end, before_number = True, False
                continue
            kind = "number" if w[0].isdigit() else "unit" if w.lower() in decontamination.UNITS and before_number else "name" if w[0].isupper() and not before_end else ""
            out.append([w.casefold(), kind, before_end, True])
            before_end, before_number = False, w[0].isdigit()
        tokens = decontamination.TOKENS.findall(text or "")
        at = [i for i, w in enumerate(tokens) if w[0].isalpha() or w[0].isdigit()]
        for row, i in zip(out, at, strict=True):
            row[3] = i + 1 == len(tokens) or not (tokens[i + 1][0].isalpha() or tokens[i + 1][0].isdigit())
        return out

    def one_to_one(x, y):
        return len(set(zip(x, y, strict=True))) == len(set(x)) == len(set(y))

    def match(a, b, slots):
        if any((p[1] if p[1] in slots else "") != (q[1] if q[1] in slots else "") for p, q in zip(a, b, strict=True)):
            return False
        if any(p[0] != q[0] for p, q in zip(a, b, strict=True) if p[1] not in slots):
            return False
        filled = [(p[0], q[0]) for p, q in zip(a, b, strict=True) if p[1] in slots]
        return one_to_one([p for p, _ in filled], [q for _, q in filled])

    def literal(window, slots):
        stretch = min(decontamination.STRETCH, len(window))
        return any(sum(k not in slots for _, k, *_ in window[i : i + stretch]) >= min(decontamination.LITERAL, len(window)) for i in range(len(window) - stretch + 1))

    out = set()
    for d, text in enumerate(texts):
        doc = reading(text)
        for key, own in rows:
            item = reading(own)
            size = min(decontamination.RUN, len(item))
            if not size:
                continue
            ways = [("number", "unit", "name"), ("number", "unit"), ()] if size >= decontamination.LEAST else [()]
            if any(
                match(item[q : q + size], doc[p : p + size], slots)
                for slots in ways for q in range(len(item) - size + 1) if not slots or literal(item[q : q + size], slots) for p in range(len(doc) - size + 1)
            ):
                out.add((d, key))
            whole = ("number", "unit", "name")
            if decontamination.LEAST <= size < decontamination.RUN and not literal(item, whole) and sum(k not in whole for _, k, *_ in item) >= decontamination.SENTENCE_LITERAL:
                if any(match(item, doc[p : p + size], whole) and doc[p][2] and doc[p + size - 1][3] for p in range(len(doc) - size + 1)):
                    out.add((d, key))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_random_templates_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(decontamination, "CHUNK", 300)
    rng = random.Random(seed)
    common, names = ["the", "a", "has", "kg", "of", "km", "and", "gives", "to", "in"], ["Ann", "Bob", "Tom", "Eve"]

    def sentence(n):
        return " ".join(rng.choice([rng.choice(common), rng.choice(common), rng.choice(names), str(rng.randrange(4)), "."]) for _ in range(n))

    rows = [(k, sentence(rng.randrange(1, 40))) for k in range(30)]
    texts = [None, ""]
    for _ in range(60):
        t = rng.choice(rows)[1].split()
        for old in {w for w in t if w in names or w.isdigit()}:
            if rng.random() < 0.5:
                new = rng.choice(names) if old in names else str(rng.randrange(10))
                t = [new if w == old and rng.random() < 0.95 else w for w in t]
        cut = rng.randrange(len(t))
        text = f"{sentence(rng.randrange(6))} {' '.join(t[cut // 3 :])} {sentence(rng.randrange(6))}"
        texts.append(rng.choice([str, str, str.upper, str.lower])(text))
    expected = brute_force(texts, rows)
    docs, benchmark = table(spark, texts), items(spark, rows)
    windows = decontamination.benchmark_windows(benchmark)
    got = decontamination.window_hits(docs, windows).join(windows.select("h", "h2", "item"), ["h", "h2"])
    assert {(r.doc, r.item) for r in got.select("doc", "item").distinct().collect()} == expected and len(expected) > 20
    leaked = {d for d, _ in expected}
    assert {r.doc_id for r in decontamination.find_leaks(docs, benchmark).collect()} == leaked
    assert {r.doc_id for r in decontamination.without_leaks(docs, benchmark).collect()} == set(range(len(texts))) - leaked


def test_bitmap_holds_every_window(spark):
    windows = decontamination.benchmark_windows(items(spark, [(k, f"{ITEM} number {k}") for k in range(50)]))
    bits, table_ = decontamination.bitmap(windows)
    h = np.array([r.h for r in windows.select("h").collect()], np.int64).view(np.uint64) >> np.uint64(64 - bits)
    assert ((table_[h >> np.uint64(3)] >> (h & np.uint64(7)).astype(np.uint8)) & 1).all() and table_.nbytes == 1 << (bits - 3)


def test_items_of_a_very_large_class_are_each_told(spark):
    rng = random.Random(2)
    word = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    shared = word(20)
    got = found(spark, [f"before {shared} after"], [(k, f"{shared} {word(k % 4)}") for k in range(150)])
    assert {k: round(r.coverage, 6) for k, r in got.items()} == {(0, k): round(20 / (20 + k % 4), 6) for k in range(150)}
    assert {r.n_items for r in got.values()} == {150}
