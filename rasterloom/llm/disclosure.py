"""Personal data in texts, and the terms beside it that give it away: DataFrame functions only.

Base patterns find e-mail addresses, IP addresses, card and telephone numbers. What they match is a
protected entity. For a term t within ``WINDOW`` words of a mention of entity e, the corpus gives

    PMI(e; t) = log2 p(e | t) / p(e)        IC(e) = -log2 p(e)        disclosure = PMI / IC

where p(e | t) is the share of t's occurrences, over all words of all texts, that lie beside e, and p(e)
the share of all words that do. Disclosure is 1 where t occurs beside e alone. A term seen beside e in
fewer than ``support`` different surroundings says nothing (copies of a text are one surrounding). From
``generalise`` on a term is replaced by its class, from ``remove`` on it goes; only
occurrences beside a mention are touched, so a text without personal data stays as it is.

Nulls: a null text has no spans. Empty texts and tables: none, and no rows. Repeated rows: each has its own
result, and their surroundings count once. Ties: spans of a kind are in order of their start. Very long texts: matching
is linear in the text, gathering in the number of matches. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm import common

# Possessive repeats and the looks behind leave each pattern's matches as they are: they only keep a long run
# of letters or digits from being tried again at each of its places.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
#: Without this a text has no match; looked for first.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
#: Words on each side of a mention, and the code points that are searched for them.
WINDOW, REACH = 10, 120
WORD = r"[\p{L}\p{N}]+"
#: Occurrences of one entity and term are met in so many groups.
SALTS = 8
#: Positions that are gathered before they are set aside; bounds the copying to a list's length times this.
_BLOCK = 256
#: A character between matches; texts' own are read as another control character, which no pattern holds.
_MARK, _OTHER = "\x01", "\x02"


def matches(text: Column, pattern: str, reach: int = 0) -> Column:
    """Array of (start, word, before, after) of the leftmost matches that do not overlap, in order.

    start is in code points from 0; before and after are at most ``reach`` code points of what lies between a
    match and its neighbours. One fold over the pieces of the text, so nothing is searched twice.
    """
    marked = F.regexp_replace(F.translate(text, _MARK, _OTHER), pattern, f"{_MARK}$0{_MARK}")
    item = "array<struct<start:bigint,word:string,before:string,after:string>>"
    zero = F.struct(
        F.lit(0).cast("bigint").alias("at"), F.lit(False).alias("inside"), F.lit("").alias("gap"), F.lit("").alias("word"), F.lit(0).cast("bigint").alias("start"),
        F.array().cast(item).alias("block"), F.array().cast(f"array<{item}>").alias("done"),
    )

    def step(a: Column, piece: Column) -> Column:
        match = a["inside"]
        ended = ~match & (a["at"] > 0) & (F.length(a["word"]) > 0)
        found = F.struct(a["start"].alias("start"), a["word"].alias("word"), a["gap"].alias("before"), F.substring(piece, 1, reach).alias("after"))
        whole = F.size(a["block"]) >= _BLOCK
        block = F.when(ended, F.concat(F.when(whole, F.array().cast(item)).otherwise(a["block"]), F.array(found))).otherwise(a["block"])
        return F.struct(
            (a["at"] + F.length(piece)).cast("bigint").alias("at"), (~match).alias("inside"), F.when(match, a["gap"]).otherwise(F.substring(piece, -reach, reach) if reach else F.lit("")).alias("gap"),
            F.when(match, piece).otherwise(F.lit("")).alias("word"), F.when(match, a["at"]).otherwise(a["start"]).alias("start"),
            block.alias("block"), F.when(ended & whole, F.concat(a["done"], F.array(a["block"]))).otherwise(a["done"]).alias("done"),
        )

    return F.aggregate(F.split(marked, _MARK, -1), zero, step, lambda a: F.flatten(F.concat(a["done"], F.array(a["block"]))))


def _digits(word: Column) -> Column:
    return F.regexp_replace(word, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    total = F.aggregate(
        F.split(F.reverse(digits), ""), F.struct(F.lit(0).alias("sum"), F.lit(False).alias("second")),
        lambda a, c: F.struct((a["sum"] + F.when(a["second"], F.translate(c, "0123456789", "0246813579").cast("int")).otherwise(c.cast("int"))).alias("sum"), (~a["second"]).alias("second")),
        lambda a: a["sum"],
    )
    return total % 10 == 0


def _holds(kind: str, word: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
        return word.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.length(_digits(word)).between(16, 19) & luhn(_digits(word))
    if kind == "phone":
        return F.length(_digits(word)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str, reach: int = 0) -> Column:
    """The matches of a kind that hold; what fails is dropped, nothing shorter is tried instead."""
    found = F.filter(matches(text, PATTERNS[kind], reach), lambda m: _holds(kind, m["word"]))
    none = F.array().cast("array<struct<start:bigint,word:string,before:string,after:string>>")
    if kind not in NEEDS:
        return F.when(text.isNull(), none).otherwise(found)
    return F.when(F.coalesce(F.contains(text, F.lit(NEEDS[kind])), F.lit(False)), found).otherwise(none)


def _entity(kind: Column, word: Column) -> Column:
    """How equal entities are told: addresses in small letters, numbers by their digits."""
    return F.concat(kind, F.lit(":"), F.when(kind.isin("card", "phone"), _digits(word)).otherwise(F.lower(word)))


def found_data(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, key, email, ip, card, phone) of every text: the base spans with their surroundings, stored; ``row`` tells repeated keys apart."""
    out = texts.select(F.col(key), F.col(text).cast("string").alias("_t"))
    return common.stored(out.select(F.monotonically_increasing_id().alias("row"), F.col(key), *(base_spans(F.col("_t"), k, REACH).alias(k) for k in KINDS)), "disclosure-found")


def term_mentions(found: DataFrame) -> DataFrame:
    """(row, start, term, word, entity, context): each word beside a mention, once for each entity that it is beside."""
    def of(kind: str) -> Column:
        return F.transform(kind, lambda m: F.struct(F.lit(kind).alias("kind"), *(m[c].alias(c) for c in ("start", "word", "before", "after"))))

    one = found.select("row", F.explode(F.concat(*map(of, KINDS))).alias("m")).select("row", "m.*")
    # A word that the reach cuts in two is none; each side keeps its nearest words.
    left = F.filter(matches(F.col("before"), WORD), lambda w: (w["start"] > 0) | (F.length("before") < REACH))
    right = F.filter(matches(F.col("after"), WORD), lambda w: (w["start"] + F.length(w["word"]) < F.length("after")) | (F.length("after") < REACH))
    near = F.concat(
        F.transform(F.slice(F.reverse(left), 1, WINDOW), lambda w: F.struct((F.col("start") - F.length("before") + w["start"]).alias("at"), w["word"].alias("w"))),
        F.transform(F.slice(right, 1, WINDOW), lambda w: F.struct((F.col("start") + F.length("word") + w["start"]).alias("at"), w["word"].alias("w"))),
    )
    words = one.select("row", _entity(F.col("kind"), F.col("word")).alias("entity"), F.xxhash64("before", "after").alias("context"), F.explode(near).alias("n"))
    words = words.select("row", F.col("n.at").alias("start"), F.lower("n.w").alias("term"), F.col("n.w").alias("word"), "entity", "context").where(F.col("term").rlike(r"\p{L}"))
    return words.groupBy("row", "start", "term", "word", "entity").agg(F.min("context").alias("context"))


def term_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """(term, n) over all words of all texts."""
    words = texts.select(F.explode(F.split(F.lower(F.col(text).cast("string")), r"[^\p{L}\p{N}]+")).alias("term")).where("term <> ''")
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def disclosures(mentions: DataFrame, counts: DataFrame, *, support: int = 3, generalise: float = 0.9) -> DataFrame:
    """(entity, term, disclosure) of the pairs that reach the lower threshold."""
    per_context = mentions.groupBy("entity", "term", "context").agg(F.count(F.lit(1)).alias("n"))
    pairs = per_context.groupBy("entity", "term").agg(F.sum("n").alias("together"), F.count(F.lit(1)).alias("contexts"))
    beside = mentions.groupBy("entity").agg(F.count(F.lit(1)).alias("beside"))
    counts = common.stored(counts, "disclosure-counts")
    words = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not words:
        return pairs.select("entity", "term", F.lit(0.0).alias("disclosure")).where("false")
    known = pairs.where(F.col("contexts") >= support).join(counts, "term").join(beside, "entity")
    ic = -F.log2(F.col("beside") / F.lit(float(words)))
    # A term's occurrences are counted over whole words, as those beside a mention are.
    return known.select("entity", "term", ((F.log2(F.least(F.lit(1.0), F.col("together") / F.col("n"))) + ic) / ic).alias("disclosure")).where(F.col("disclosure") >= generalise)


def _class(word: Column) -> Column:
    """What a term is generalised to."""
    return F.when(word.rlike(r"\p{N}"), "[code]").when(word.rlike(r"^\p{Lu}"), "[name]").otherwise("[word]")


def find(texts: DataFrame, *, key: str = "doc_id", text: str = "text", support: int = 3, generalise: float = 0.9, remove: float = 0.98) -> DataFrame:
    """(row, key, email, ip, card, phone, term): arrays of (start, end, put), put being what stands instead.

    A base span gets its kind; a term that overlaps a base span is none.
    """
    found = found_data(texts, key, text)
    mentions = common.stored(term_mentions(found), "disclosure-mentions")
    known = disclosures(mentions, term_counts(texts, text), support=support, generalise=generalise)
    known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    told = mentions.withColumn("salt", F.pmod(F.col("row"), F.lit(SALTS)).cast("int")).join(known, ["entity", "term", "salt"]).groupBy("row", "start", "word").agg(F.max("disclosure").alias("d"))
    terms = told.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.length("word")).alias("end"), F.when(F.col("d") >= remove, "").otherwise(_class(F.col("word"))).alias("put")))).alias("term"))

    def ends(kind: str) -> Column:
        return F.transform(kind, lambda m: F.struct(m["start"].alias("start"), (m["start"] + F.length(m["word"])).alias("end"), F.lit(f"[{kind}]").alias("put"))).alias(kind)

    out = found.select("row", key, *map(ends, KINDS)).join(terms, "row", "left")
    base = F.concat(*KINDS)
    clear = F.filter("term", lambda t: ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return out.withColumn("term", F.coalesce(clear, F.array().cast("array<struct<start:bigint,end:bigint,put:string>>")))


def _listed(kinds: Sequence[str]) -> Column:
    def shown(kind: str) -> Column:
        return F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    return F.array_join(F.concat(*map(shown, kinds)), ",")


def digest(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term) of what ``find`` found."""
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return spans.select(key, *counts, F.sha2(_listed(KINDS), 256).alias("base_sha256"), _listed((*KINDS, "term")).alias("spans"), F.size("term").cast("long").alias("n_term"))


def sanitised(texts: DataFrame, *, key: str = "doc_id", text: str = "text", **options: float) -> DataFrame:
    """(key, text): each text with its spans replaced; of spans that overlap the first, and of those the longest, says what stands for all.

    Rows are those of the input. The time is the text's length times its number of spans.
    """
    # Row numbers hold for one reading of the input, so texts and spans come from one stored table.
    kept = common.stored(texts.select(F.monotonically_increasing_id().alias("at"), F.col(key), F.col(text).cast("string").alias("text")), "disclosure-texts")
    # By start, the longest first.
    ordered = F.array_sort(F.transform(F.concat(*KINDS, "term"), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["put"].alias("put"))))
    spans = find(kept, key="at", text="text", **options).select("at", ordered.alias("spans"))
    zero = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def step(a: Column, s: Column) -> Column:
        between = F.substring(F.col("text"), (a["at"] + 1).cast("int"), F.greatest(F.lit(0), s["start"] - a["at"]).cast("int"))
        # Spans are in order of their start, so one that begins before the place reached continues the last.
        put = F.when((a["at"] > 0) & (s["start"] < a["at"]), F.lit("")).otherwise(s["put"])
        return F.struct(F.concat(a["out"], between, put).alias("out"), F.greatest(a["at"], -s["back"]).alias("at"))

    rest = F.aggregate("spans", zero, step, lambda a: F.concat(a["out"], F.substring(F.col("text"), (a["at"] + 1).cast("int"), F.lit(2**31 - 1))))
    return kept.join(spans, "at").select(key, F.when(F.size("spans") == 0, F.col("text")).otherwise(rest).alias("text"))
