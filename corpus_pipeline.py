"""From raw documents to packed training sequences: five stages, each over all rows that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns documents again (the last one: packed pieces).  A stage's
decisions go by doc_id: rows of equal id stay or go together, rows without an id are never dropped.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparksheet.llm import lines, mixing, neardup, packing, quality
from sparksheet.llm.common import cut, discard, free_name, table
from sparksheet.llm.queries import tokenizer_path

#: Rows that a Python worker gets at once, and words whose tokens it keeps: what its memory holds beside that of the stages before.
BATCH_ROWS, KEPT_WORDS = 2000, 60_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _in_small_batches(stage: Callable) -> Callable:
    """The stage, with few rows at once on their way to Python workers in all jobs that it runs itself."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        given = spark.conf.get(_BATCH)
        spark.conf.set(_BATCH, str(min(int(given), BATCH_ROWS) if int(given) > 0 else BATCH_ROWS))
        try:
            return stage(spark, docs, sf_dir)
        finally:
            spark.conf.set(_BATCH, given)

    return run


def _without(docs: DataFrame, out: DataFrame) -> DataFrame:
    """docs less the ids of out, which are written down first: what judges the texts has ended when they are joined."""
    name = free_name(docs, "gone")
    gone = cut(out.select(F.col("doc_id").alias(name)).distinct())
    return docs.join(gone, docs["doc_id"] == F.col(name), "left_anti")


@_in_small_batches
def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of low quality and toxic ones go."""
    return _without(docs, quality.classify(docs, table(spark, sf_dir, "labels")).where("not keep"))


@_in_small_batches
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines repeated within one edit (short ones: exactly) go, but for the first; a document left without lines stays as an empty one."""
    aside = {c: free_name(docs, f"own_{c}") for c in docs.columns if c.lower() in ("n_lines", "n_removed", "removed")}  # the caller's columns of the operator's names
    clean = lines.dedup_lines(docs.withColumnsRenamed(aside))
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", n_chars).select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])


@_in_small_batches
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five-word shingles, similarity 0.8)."""
    return _without(docs, neardup.near_duplicates(docs).where("not kept"))


@_in_small_batches
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources, languages and topics at tempered shares of the tokens."""
    return _without(docs, mixing.mix(docs).where("not keep"))


@_in_small_batches
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens.  Pieces are written down before they are packed: a task then has one Python worker, not one for either step."""
    pieces = cut(packing.tokenize(docs, tokenizer_path(spark), keep=False, most=KEPT_WORDS))
    return packing.pack(pieces)


STAGES = [("quality", quality_filter), ("lines", line_dedup), ("near_duplicates", near_dedup), ("mixing", mix_sources), ("packing", pack_sequences)]

#: No stage can be said in SQL; tests hold each, and run(), against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = []
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
