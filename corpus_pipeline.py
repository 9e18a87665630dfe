"""From raw documents to training input in five stages; each calls one operator of ``tokenloom.llm`` on all that its predecessor kept.

Rows with a repeated or null id are rows of their own in every dedup stage.  All stages take empty tables and columns beyond those they
read.  A stage's result reads scratch tables until it is written; the next stage removes those of the stages before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tokenloom.llm import common, exact_dedup, mixing, ngram_join, pieces, quality_rules

VOCABULARY = "piece_bpe_32k.model"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


_kept: list[common.Scratch] = []


def written(spark: SparkSession, docs: DataFrame) -> None:
    """Removes what earlier stages left, unless ``docs`` still reads it."""
    files = docs.inputFiles()
    if not any(f"/{one.root.rstrip('/').rpartition('/')[2]}/" in f for f in files for one in common.Scratch.made if one not in _kept):
        for one in [x for x in common.Scratch.made if x.spark is spark and x not in _kept]:
            one.drop("")
            common.Scratch.made.remove(one)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule, or whose posterior quality is low, go."""
    written(spark, docs)
    return quality_rules.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays: the longest original, then the smallest id."""
    written(spark, docs)
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component at Jaccard 0.8 on five-word shingles stays."""
    written(spark, docs)
    return ngram_join.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    written(spark, docs)
    return mixing.remixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds piece_ids, and decoded: the bytes that they stand for."""
    written(spark, docs)
    return pieces.encoded(docs, vocabulary_path(), back="decoded")


STAGES = [("quality rules", quality), ("exact dedup", exact), ("n-gram join", near), ("mixing", mix), ("pieces", encode)]

#: Expectation-maximisation, entropy balancing and Viterbi aren't expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    scratch = common.Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    _kept.append(scratch)
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        scratch.release()
    written(spark, docs)
    return docs
