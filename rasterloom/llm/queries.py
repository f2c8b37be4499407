"""The queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rasterloom.llm import common, decontamination, disclosure, fingerprints, html_text, importance, jaccard_join, packing, pfor, suffix_dedup, token_counts, toxicity, warc, whitening
from rasterloom.llm.tokens import default_tokenizer


def op1_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(common.table(spark, sf_dir, "documents"))


def op2_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest_repeats(common.table(spark, sf_dir, "documents"))


def op4_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(common.table(spark, sf_dir, "pages"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(common.table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op6_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(common.table(spark, sf_dir, "pages"), common.scratch_path(spark, "warc"), least=0)
    return warc.read_archives(manifest)


def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = common.scratch_path(spark, "pfor")
    manifest = pfor.write_token_files(common.table(spark, sf_dir, "documents"), default_tokenizer(), out, end_id=0)
    return pfor.read_token_files(manifest, pfor.crc_row, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.attribute_sections(common.table(spark, sf_dir, "documents"), default_tokenizer(), rule="most")


def op9_toxicity_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, common.table(spark, sf_dir, "labels")))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(common.table(spark, sf_dir, "documents"), default_tokenizer(), capacity=1024, end_id=2)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op12_information_theoretic_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.digest(disclosure.find(common.table(spark, sf_dir, "documents")))


def op13_compensated_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(common.table(spark, sf_dir, "embeddings"))


#: CRC-32 byte by byte over hex digits, by a table made from the polynomial.
IMPORTANCE_SQL = r"""WITH crc_table AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS entries
  FROM (SELECT unnest(range(256)) AS i)),
texts AS (SELECT 's' AS corpus, doc_id, text FROM documents UNION ALL SELECT 't', NULL, text FROM benchmark),
cut AS (
  SELECT corpus, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
runs AS (
  SELECT corpus, doc_id, unnest(w) AS feature FROM cut
  UNION ALL SELECT corpus, doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM cut
  UNION ALL SELECT corpus, doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM cut),
counted AS (SELECT corpus, doc_id, feature, count(*) AS n FROM runs GROUP BY ALL),
bytes AS (SELECT feature, hex(feature) AS h FROM (SELECT DISTINCT feature FROM counted)),
hashed AS (
  SELECT feature, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)), lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM bytes, crc_table),
posting AS (SELECT corpus, doc_id, bucket, sum(n) AS n FROM counted JOIN hashed USING (feature) GROUP BY ALL),
size AS (SELECT coalesce(sum(n) FILTER (corpus = 's'), 0) AS s, coalesce(sum(n) FILTER (corpus = 't'), 0) AS t FROM posting),
sums AS (SELECT bucket, coalesce(sum(n) FILTER (corpus = 's'), 0) AS s, coalesce(sum(n) FILTER (corpus = 't'), 0) AS t FROM posting GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((sums.t + 1)::DOUBLE * (size.s + 10000)::DOUBLE / ((sums.s + 1)::DOUBLE * (size.t + 10000)::DOUBLE))) AS gain FROM sums, size),
weighed AS (
  SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM posting JOIN gains USING (bucket) WHERE corpus = 's' GROUP BY doc_id),
scored AS (
  SELECT c.doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || c.doc_id), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM cut c LEFT JOIN weighed USING (doc_id) WHERE corpus = 's'),
placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * n // 100 THEN place END AS rank FROM scored LEFT JOIN placed USING (doc_id)"""


_QUERIES = (
    op1_weighted_fingerprints, op2_template_decontamination, op3_suffix_array_dedup, op4_html_main_text, op5_ngram_jaccard_join, op6_warc_roundtrip, op7_token_file, op8_token_counts, op9_toxicity_kneser_ney,
    op10_best_fit_packing, op11_importance_resampling, op12_information_theoretic_pii, op13_compensated_whitening,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op11_importance_resampling": IMPORTANCE_SQL}
