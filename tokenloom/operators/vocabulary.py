"""Transforms of vocabularies as DataFrame plans, for vocabularies that are tables themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_ranks(merges: DataFrame) -> DataFrame:
    """token, rank from (left, right, idx): a token has the rank of the first merge that makes it."""
    return merges.groupBy(F.concat("left", "right").alias("token")).agg(F.min("idx").alias("rank"))


def bpe_order(vocab: DataFrame, merges: DataFrame) -> DataFrame:
    """vocab (token, id) with sort_rank: merged tokens by their merge, the others after them by id."""
    ranked = vocab.join(merge_ranks(merges), "token", "left")
    return ranked.withColumn("sort_rank", F.row_number().over(Window.orderBy(F.col("rank").asc_nulls_last(), "id")) - 1)


def first_of_equal(vocab: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: the first by order."""
    return vocab.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("n = 1").drop("n")


def piece_merges(pieces: DataFrame) -> DataFrame:
    """pieces (token, score, id) with merged: whether some cut leaves two pieces; such come by falling score, others by id."""
    cuts = pieces.where(F.length("token") > 1).select("token", F.explode(F.sequence(F.lit(1), F.length("token") - 1)).alias("k"))
    halves = cuts.select("token", F.substring("token", F.lit(1), F.col("k")).alias("a"), F.substring("token", F.col("k") + 1, F.length("token")).alias("b"))
    known = pieces.select(F.col("token").alias("a"))
    merged = halves.join(known, "a", "left_semi").join(known.withColumnRenamed("a", "b"), "b", "left_semi").select("token").distinct()
    return pieces.join(merged.withColumn("merged", F.lit(True)), "token", "left").withColumn("merged", F.coalesce("merged", F.lit(False)))


def without_specials(vocab: DataFrame, specials: DataFrame) -> DataFrame:
    return vocab.join(specials.select("token"), "token", "left_anti")


def repaired_specials(specials: DataFrame, vocab: DataFrame) -> DataFrame:
    """specials (token, id, ord): one whose id is another token's gets the next id above the vocabulary, in order of ord.

    Special tokens are few; those that clash are numbered in one task, and the others don't meet.
    """
    clash = vocab.select("id", F.col("token").alias("other"))
    marked = specials.join(clash, "id", "left").withColumn("bad", F.coalesce(F.col("other") != F.col("token"), F.lit(False)))
    most = vocab.agg(F.coalesce(F.max("id"), F.lit(0)).alias("most"))
    new = F.col("most") + F.row_number().over(Window.orderBy("ord"))
    moved = marked.where("bad").join(F.broadcast(most)).select("token", new.alias("id"), "ord")
    return marked.where("not bad").select("token", "id", "ord").unionByName(moved)


def decoded_byte(token: Column) -> Column:
    """The byte that a token such as <0x41> stands for, else its own bytes."""
    digits = F.regexp_extract(token, r"\A<0x([0-9A-Fa-f]{2})>\z", 1)
    return F.when(digits != "", F.unhex(digits)).otherwise(token.cast("binary"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of two vocabularies (id, token) that differ, with the side they are on."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).union(b.exceptAll(a).withColumn("side", F.lit("b")))
