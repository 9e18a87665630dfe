"""Exact dedup by content sort, in DataFrame functions only.

Splitters sampled by Spark range-partition the rows on the head of the normalised text, its first HEAD_CHARS characters; within a
partition an external sort by whole normalised texts puts equal ones next to each other and each row is compared in full with its
neighbour.  The driver's sample holds heads, so it doesn't grow with the length of texts.

A head with more than ``hot`` rows (templates, copies) is dealt over ceil(rows / hot) shards by the text's SHA-256, which keeps equal
texts together; a text with more than ``hot`` rows is dealt on by id.  Each shard elects its survivor, then the survivors of one
text (one row for each shard) are compared, again in full.  No row is dropped.

Before the exchange only heads are made, from the first LOOK characters where these hold enough; texts are normalised and hashed
once, after it.

Nulls: a null text counts as empty; a null id sorts last, so it survives only among null ids.  Repeated rows form groups like any
other copies and exactly one of them is kept.  Texts of any length are compared whole.  Columns that are carried may have any
name.  Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, text_or_empty, without_spaces

HOT = 500
HEAD_CHARS, LOOK = 64, 512


def head_of(raw: Column) -> Column:
    """The first HEAD_CHARS characters of the normalised text; the whole text is normalised only where LOOK characters hold fewer."""
    start = without_spaces(F.substring(raw, 1, LOOK))
    enough = (F.char_length(start) >= HEAD_CHARS) | (F.char_length(raw) <= LOOK)
    return F.when(enough, F.substring(start, 1, HEAD_CHARS)).otherwise(F.substring(without_spaces(raw), 1, HEAD_CHARS))


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", hot: int = HOT, whole: bool = False) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, and with ``whole`` the row itself as c0, c1 ..."""
    columns = docs.columns if whole else list(dict.fromkeys([doc_id, text]))
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    own_id, own_text = (F.col(f"row.c{columns.index(x)}") for x in (doc_id, text))
    raw, norm = text_or_empty(own_text), without_spaces(text_or_empty(own_text))
    rows = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]).alias("row"))
    rows = rows.withColumn("head", head_of(raw))
    # At most rows / hot heads, and as many texts.
    hot_heads = rows.groupBy("head").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("head", F.ceil(F.col("n") / hot).alias("deals"))
    hot_heads = scratch.table(hot_heads, "heads")
    split = bool(hot_heads.take(1))
    if split:
        inside = rows.join(hot_heads, "head").select(F.sha2(norm, 256).alias("sha")).groupBy("sha").agg(F.count("*").alias("n"))
        hot_texts = scratch.table(inside.where(F.col("n") > hot).select(F.col("sha").alias("key"), F.ceil(F.col("n") / hot).alias("parts")), "texts")
        rows = rows.join(hot_heads, "head", "left").withColumn("key", F.when(F.col("deals").isNull(), F.col("head")).otherwise(F.sha2(norm, 256)))
        rows = rows.join(hot_texts, "key", "left")
        deal = F.coalesce(F.pmod(F.xxhash64("key"), F.col("deals")), F.lit(0))
        part = F.coalesce(F.pmod(F.xxhash64(own_id, F.char_length(raw)), F.col("parts")), F.lit(0))
        rows = rows.select("row", "head", deal.alias("deal"), part.alias("part"), F.col("parts").isNotNull().alias("split"))
    else:
        rows = rows.select("row", "head", F.lit(0).cast("long").alias("deal"), F.lit(0).cast("long").alias("part"), F.lit(False).alias("split"))

    key, order = ["head", "deal", "part"], [F.col("chars").desc(), F.col("doc_id").asc_nulls_last()]
    out = ["doc_id", "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"), *(["row.*"] if whole else [])]

    def local(some: DataFrame) -> DataFrame:
        """Groups within a shard: copies are neighbours in the order of whole texts."""
        carried = ["row"] if whole else []
        placed = some.repartitionByRange(*key).select(*key, *carried, own_id.alias("doc_id"), F.char_length(raw).alias("chars"), norm.alias("norm"), F.sha2(norm, 256).alias("sha"))
        near = Window.partitionBy(*key).orderBy("norm", *order)
        placed = placed.withColumn("first", F.when(F.lag("norm").over(near) == F.col("norm"), 0).otherwise(1)).withColumn("run", F.sum("first").over(near))
        placed = placed.withColumn("norm", F.when(F.col("first") == 1, F.col("norm")))
        of_run = Window.partitionBy(*key, "run")
        keep = F.first("doc_id").over(of_run.orderBy(F.col("first").desc(), *order))
        return placed.withColumn("keep_id", keep).withColumn("group_size", F.count("*").over(of_run)).withColumn("kept", F.col("first") == 1)

    if not split:
        return local(rows).select(*out)
    dealt = scratch.table(local(rows.where("split")).drop("head", "first"), "dealt")
    shard = ["sha", "deal", "part", "run"]
    of_text = Window.partitionBy("sha", "norm")
    best = of_text.orderBy(*order, *shard[1:])
    elected = dealt.where("kept").select(
        *shard,
        F.first("doc_id").over(best).alias("keep_all"),
        F.sum("group_size").over(of_text).alias("size_all"),
        (F.row_number().over(best) == 1).alias("best"),
    )
    merged = (
        dealt.drop("keep_id", "group_size").join(elected, shard)
        .withColumnsRenamed({"keep_all": "keep_id", "size_all": "group_size"}).withColumn("kept", F.col("kept") & F.col("best"))
    )
    return local(rows.where("not split")).select(*out).unionByName(merged.select(*out))


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", hot: int = HOT) -> DataFrame:
    """The rows that stay, with the columns of ``docs``."""
    kept = exact_groups(docs, text, doc_id, hot, whole=True).where("kept")
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


SQL = r"""
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, length(coalesce(text, '')) AS chars,
             regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
WINDOW w AS (PARTITION BY norm ORDER BY chars DESC, doc_id ASC NULLS LAST)
"""
