"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Rates r of documents minimise sum(r log r - r + 1) under sum(size * r) = target for each source and r <= 2.  The dual has one
multiplier for each source and r = min(2, exp(multiplier * size / scale)).  Newton steps from both ends of a bracket, with three
points between them, run for all sources at once as aggregates over the (source, size) histogram, so a step reads a few rows for
each source however many documents there are, and a source with a third of all rows is no heavier than another.  Rounds go on
until every source meets its target, or the operator fails.

Rates become copies on the histogram: from the largest size down, a cell of documents takes the whole part of its copies and what
the running sum of the fractions gives; what is then left of a target goes to the largest documents that fit it and have room.  Within a
cell the documents with the smallest draws (a hash of id and text) take one copy more.  A source misses its target by less than
the size of one document, unless no document that has room is that small.  Distinct sizes of a source are at most
sqrt(2 * its words), which bounds the rows that a window sorts; sources are ranked over range partitions.

Nulls: a null source is a source of its own, last in order; a null text has size 0, and so has an empty one.  Long texts are
counted whole.  Rows that agree in id and text draw alike and so may miss a target by their number times their size.  A target of
0 takes nothing.  An empty table gives an empty result.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, before_each, text_or_empty

WEIGHTS = (3.0, 1.0, 2.0)
BUDGET = 1.5
CAP = 2
#: Steps planned as one job, and how often such jobs may follow each other.
CHAIN, CHAINS = 6, 20
FILLS = 3
TOLERANCE = 1e-6
#: Documents of one size that share a bucket of draws.
BUCKET = 256
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def targets(histogram: DataFrame, scratch: Scratch, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """source, source_size, filled, target.  Shares above ``cap`` times a source's size go to the others by weight.

    The level (words for each unit of weight) rises until the set of sources that are full at it stays the same: Newton's method
    on a function of straight pieces.  A step reads one row for each source and brings back three numbers.
    """
    words, filled = F.sum(F.col("size") * F.col("docs")), F.sum(F.when(F.col("size") > 0, F.col("docs")).otherwise(0))
    per = histogram.groupBy("source").agg(words.alias("source_size"), filled.alias("filled"))
    per = before_each(per, [F.col("source").asc_nulls_last()], {"rank": F.lit(1)}, scratch, "ranked")
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", pick).withColumn("full", cap * F.col("source_size") / F.col("weight"))
    level, known = 0.0, -1
    while True:
        at = F.col("full") <= level if known >= 0 else F.lit(False)
        row = per.agg(
            F.count(F.when(at, 1)).alias("n"), F.sum("source_size").alias("size"), F.sum(F.when(at, F.col("source_size")).otherwise(0)).alias("size_full"),
            F.sum(F.when(~at, F.col("weight")).otherwise(0)).alias("rest"),
        ).first()
        if row["n"] == known or not row["rest"]:
            break
        level, known = (budget * row["size"] - cap * row["size_full"]) / row["rest"], row["n"]
    target = F.when(F.col("full") <= level, cap * F.col("source_size")).otherwise(F.col("weight") * level)
    return per.select("source", "source_size", "filled", target.cast("double").alias("target"))


def exact_sum(value: Column) -> Column:
    """A sum in units of 1/1024 as integers, so that the order of rows can't change it and reruns agree."""
    return F.sum(F.round(value * 1024).cast("long")) / 1024


def rate(cap: float, multiplier: Column) -> Column:
    return F.when(F.col("full"), F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), F.exp(F.least(multiplier * F.col("size") / F.col("scale"), F.lit(50.0)))))


def newton(histogram: DataFrame, state: DataFrame, cap: float) -> DataFrame:
    """One step for all sources: the sums at each of ``tries``, the bracket that they leave, and the next tries within it."""
    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    fixed = ["source", "source_size", "filled", "target", "scale", "full"]
    at = histogram.alias("a").join(state.alias("b"), same).select(*[f"b.{c}" for c in fixed], "b.low", "b.high", "a.size", "a.docs", F.explode("b.tries").alias("try"))
    words = F.col("size") * F.col("docs") * rate(cap, F.col("try"))
    slope = F.when(rate(cap, F.col("try")) < cap, words * F.col("size") / F.col("scale")).otherwise(0.0)
    sums = at.groupBy(*fixed, "try").agg(F.first("low").alias("low"), F.first("high").alias("high"), exact_sum(words).alias("words"), exact_sum(slope).alias("slope"))
    end = F.struct(F.col("try").alias("at"), "words", "slope")
    found = sums.groupBy(*fixed).agg(
        F.max(F.when(F.col("words") <= F.col("target"), end)).alias("new_low"), F.min(F.when(F.col("words") > F.col("target"), end)).alias("new_high"),
        F.first("low").alias("low"), F.first("high").alias("high"),
    )
    found = found.withColumn("low", F.greatest("low", "new_low")).withColumn("high", F.least("high", "new_high"))
    low, high = F.col("low.at"), F.col("high.at")
    from_end = lambda x: F.col(f"{x}.at") - F.when(F.col(f"{x}.slope") > 0, (F.col(f"{x}.words") - F.col("target")) / F.col(f"{x}.slope"))
    points = F.array(from_end("low"), from_end("high"), *[low + (high - low) * k / 4 for k in (1, 2, 3)])
    inside = F.filter(points, lambda x: (x > low) & (x < high))
    return found.select(*fixed, "low", "high", F.when(F.size(inside) > 0, F.array_distinct(inside)).otherwise(F.array(low)).alias("tries"))


def multipliers(histogram: DataFrame, wanted: DataFrame, scratch: Scratch, cap: float = CAP) -> DataFrame:
    """Of each source: source, source_size, target, scale, multiplier, full, none."""
    scale = F.greatest(F.lit(1.0), F.col("source_size") / F.greatest(F.lit(1), F.col("filled")))
    wanted = wanted.withColumn("scale", scale).withColumn("full", F.col("target") >= cap * F.col("source_size")).withColumn("none", F.col("target") <= 0)
    wanted = scratch.table(wanted, "wanted")
    spread = [0.25, 0.5, 1.0, 2.0, 4.0, 16.0, 64.0, 1e3, 1e5, 1e9]
    nothing = F.lit(None).cast("struct<at:double,words:double,slope:double>")
    state = wanted.where("not full and not none").drop("none").withColumn("low", nothing).withColumn("high", nothing)
    state = state.withColumn("tries", F.array(*[F.lit(x) for x in sorted([0.0, *spread, *[-x for x in spread]])]))
    # An end that is missing, or ends that floating point can't tell apart, are as near as it gets.
    miss = F.least(F.col("target") - F.col("low.words"), F.col("high.words") - F.col("target"))
    apart = F.col("high.at") - F.col("low.at") > 1e-12 * F.greatest(F.lit(1.0), F.abs(F.col("low.at")))
    is_open = apart & (miss > F.greatest(TOLERANCE * F.col("target"), F.lit(0.01)))
    for chain in range(CHAINS):
        for _ in range(CHAIN):
            state = newton(histogram, state, cap)
        state = scratch.table(state, f"state-{chain}")
        if not state.where(is_open).take(1):
            break
    else:
        raise ArithmeticError(f"multipliers did not converge in {CHAIN * CHAINS} steps")
    nearer = F.when(F.col("high").isNull() | (F.col("target") - F.col("low.words") <= F.col("high.words") - F.col("target")), F.col("low.at")).otherwise(F.col("high.at"))
    found = state.select(F.col("source").alias("of"), nearer.alias("multiplier"))
    return wanted.join(found, F.col("source").eqNullSafe(F.col("of")), "left").drop("of", "filled")


def cells(histogram: DataFrame, state: DataFrame, cap: int = CAP) -> DataFrame:
    """One row for each source and size: of_source, of_size, docs, source_size, target, rate, each (copies for every document), more
    (documents that take another)."""
    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    cell = histogram.alias("a").join(state.alias("b"), same).select("a.*", "b.source_size", "b.target", "b.scale", "b.multiplier", "b.full", "b.none")
    cell = cell.withColumn("rate", F.when(F.col("none"), F.lit(0.0)).otherwise(rate(cap, F.coalesce("multiplier", F.lit(0.0)))))
    want = F.when(F.col("size") > 0, F.col("docs") * F.col("rate")).otherwise(F.col("docs") * (~F.col("none")).cast("int"))
    cell = cell.withColumn("want", want).withColumn("whole", F.floor("want")).withColumn("part", F.col("want") - F.col("whole"))
    whole = Window.partitionBy("source")
    down = whole.orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, 0)
    running = F.sum("part").over(down)
    cell = cell.withColumn("copies", F.col("whole") + F.floor(running) - F.floor(F.greatest(F.lit(0.0), running - F.col("part"))))
    cell = cell.withColumn("copies", F.least("copies", cap * F.col("docs")))
    for _ in range(FILLS):
        cell = cell.withColumn("left", F.floor(F.col("target") - F.sum(F.col("size") * F.col("copies")).over(whole)))
        fits = (F.col("size") > 0) & (F.col("size") <= F.col("left")) & ~F.col("full") & ~F.col("none")
        cell = cell.withColumn("room", F.when(fits, F.col("size") * (cap * F.col("docs") - F.col("copies"))).otherwise(0))
        ahead = F.sum("room").over(down) - F.col("room")
        fill = F.floor(F.least(F.col("room"), F.greatest(F.lit(0), F.col("left") - ahead)) / F.col("size"))
        cell = cell.withColumn("copies", F.col("copies") + F.when(fits, fill).otherwise(0))
    each = F.floor(F.col("copies") / F.col("docs"))
    return cell.select(F.col("source").alias("of_source"), F.col("size").alias("of_size"), "docs", "source_size", "target", "rate", each.cast("int").alias("each"), (F.col("copies") - each * F.col("docs")).cast("long").alias("more"))


def cut_draws(sized: DataFrame, cell: DataFrame, on: Column) -> DataFrame:
    """of_source, of_size, cut: the largest draw that takes one copy more, for cells in which some do.

    Buckets of draws are counted first, so that only the documents of the bucket with the cut in it are ranked.
    """
    some = cell.where("more > 0").withColumn("buckets", F.ceil(F.col("docs") / BUCKET))
    bucket = F.floor(F.col("draw") / F.lit(float(1 << 62)) * F.col("buckets")).cast("long")
    drawn = sized.select("source", "size", "draw").join(some, on).select("of_source", "of_size", "more", "draw", bucket.alias("bucket"))
    counted = drawn.groupBy("of_source", "of_size", "more", "bucket").agg(F.count("*").alias("n"))
    running = F.sum("n").over(Window.partitionBy("of_source", "of_size").orderBy("bucket"))
    at = counted.withColumn("upto", running).where("upto >= more and upto - n < more")
    at = at.select(F.col("of_source").alias("s"), F.col("of_size").alias("z"), F.col("bucket").alias("b"), (F.col("more") - F.col("upto") + F.col("n")).alias("nth"))
    close = drawn.join(at, F.col("of_source").eqNullSafe(F.col("s")) & (F.col("of_size") == F.col("z")) & (F.col("bucket") == F.col("b")))
    place = F.row_number().over(Window.partitionBy("of_source", "of_size").orderBy("draw"))
    return close.withColumn("place", place).where("place = nth").select(F.col("of_source").alias("s"), F.col("of_size").alias("z"), F.col("draw").alias("cut"))


def mixed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", carry: dict[str, Column] | None = None,
          weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, taken, copies, rate, and what ``carry`` names."""
    carry = carry or {}
    scratch = Scratch(docs.sparkSession, "mixing")
    draw = F.shiftrightunsigned(F.xxhash64(F.col(doc_id), F.col(text), F.lit(42)), 2)
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(text_or_empty(text)).alias("size"), draw.alias("draw"), *[c.alias(k) for k, c in carry.items()])
    sized = scratch.table(sized, "sized")
    histogram = scratch.table(sized.groupBy("source", "size").agg(F.count("*").alias("docs")), "histogram")
    state = multipliers(histogram, targets(histogram, scratch, weights, budget), scratch)
    cell = scratch.table(cells(histogram, state), "cells")
    on = F.col("source").eqNullSafe(F.col("of_source")) & (F.col("size") == F.col("of_size"))
    cut = cut_draws(sized, cell, on)
    cell = scratch.table(cell.join(cut, F.col("of_source").eqNullSafe(F.col("s")) & (F.col("of_size") == F.col("z")), "left").drop("s", "z", "docs", "more"), "cut")
    out = sized.join(cell, on).withColumn("copies", F.col("each") + F.when(F.col("draw") <= F.col("cut"), 1).otherwise(0))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies", "rate", *carry)


def remixed(docs: DataFrame, **names: str) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``."""
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    mix = mixed(docs, carry={"row": row}, **names).where("copies > 0")
    mix = mix.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return mix.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
