"""A training corpus from raw documents, in five stages.

Each stage gets what its predecessor kept, written as Parquet and read again.
A stage's result is to be written before the next stage is called: that deletes
what the one before has left in the shared scratch folder. What the last one
leaves stays, as its result reads it. A run has a list of its own of such paths.

Documents of null or empty text pass the filters (empty texts are near copies of
each other, so one of them stays); an empty table gives no rows; repeated rows are near
copies; columns of any other name are kept until the last stage.
"""

from __future__ import annotations

from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from rasterloom.llm import common, decontamination, jaccard_join, packing, suffix_dedup, toxicity
from rasterloom.llm.tokens import default_tokenizer

_left: ContextVar[list[str]] = ContextVar("left")


def _paths(spark: SparkSession, *, first: bool = False) -> list[str]:
    """Where this stage notes its scratch paths; those of the stage before are deleted, but the first has none before it."""
    paths = _left.get(None)
    if paths is None or first:
        paths = []
        _left.set(paths)
    common.delete_paths(spark, paths)
    return paths


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go."""
    with common.scratch_scope(_paths(spark, first=True)):
        return toxicity.without_toxic(docs, toxicity.train(docs, common.table(spark, sf_dir, "labels")))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    with common.scratch_scope(_paths(spark)):
        return jaccard_join.keep_one(docs)


def repeated_strings_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that occur elsewhere too are cut; documents that consist of them go."""
    with common.scratch_scope(_paths(spark)):
        return suffix_dedup.remove_repeats(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    with common.scratch_scope(_paths(spark)):
        return decontamination.without_leaks(docs, common.table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences of 1024 tokens."""
    with common.scratch_scope(_paths(spark)):
        return packing.pack_documents(docs, default_tokenizer(), capacity=1024, end_id=2, kept=300_000)


STAGES = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard_join", near_duplicates_stage),
    ("suffix_array_dedup", repeated_strings_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL can't express these stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            common.discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
