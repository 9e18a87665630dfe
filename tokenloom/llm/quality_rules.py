r"""Quality rules by weak supervision, in DataFrame functions only.

Every rule votes good (+1), bad (-1) or abstains (0).  Documents are counted by their pattern of votes, at most 3 ** 8 = 6,561 rows
whatever the input's size, and expectation-maximisation over that table, which the driver holds, estimates the share of good
documents and each rule's accuracies, apart for good and for bad documents.  A document's verdict is its posterior probability of
being good.  Documents that fail the base rule have their verdict and aren't counted.

Repeated 3-word windows are found in the row itself: the windows are sorted with their positions and each is compared
with its neighbours, O(n log n) in the document's words and without a shuffle.

Nulls: a null text counts as empty and fails the base rule.  Every input row gives one output row, repeated ids included;
an empty table gives an empty result.  Texts are counted whole, however long; columns that are carried may have any name, since
they travel in a struct.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_or_empty, without_spaces, words

#: Rounds end before this when the likelihood stays the same.
ROUNDS = 500
KEEP_AT = 0.5
#: Good votes on good documents that each rule starts with, as a share of all documents.
PRIOR = 0.1


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts that rules vote on, as one struct column ``q``; ``docs`` keeps its columns."""
    raw = text_or_empty(text)
    lines = F.filter(F.split(raw, "\n"), lambda x: F.length(without_spaces(x)) > 0)
    df = docs.withColumn("q_words", words(raw)).withColumn("q_lines", lines)
    n = F.size("q_words")
    word = lambda i: F.get(F.col("q_words"), i)
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.concat_ws(" ", word(i), word(i + 1), word(i + 2)))).otherwise(F.array().cast("array<string>"))
    df = df.withColumn("q_windows", windows)
    sized = F.size("q_windows")
    ranked = F.when(F.size(F.array_distinct("q_windows")) < sized, F.sort_array(F.arrays_zip(F.col("q_windows").alias("w"), F.sequence(F.lit(0), sized - 1).alias("i"))))
    df = df.withColumn("q_ranked", ranked)
    at = lambda i: F.get(F.col("q_ranked"), i)["w"]
    again = F.filter("q_ranked", lambda x, i: (x["w"] == at(i + 1)).eqNullSafe(True) | (x["w"] == at(i - 1)).eqNullSafe(True))
    df = df.withColumn("q_again", F.transform(again, lambda x: x["i"]))
    shifted = lambda k: F.transform("q_again", lambda i: i + k)
    repeats = F.when(F.col("q_again").isNull(), F.lit(0)).otherwise(F.size(F.array_union(F.array_union(F.col("q_again"), shifted(1)), shifted(2))))
    q = F.struct(
        n.cast("long").alias("n_words"),
        F.char_length(without_spaces(raw)).cast("long").alias("word_chars"),
        F.regexp_count(raw, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long").alias("n_dup_lines"),
        repeats.cast("long").alias("n_repeat_words"),
        F.size("q_lines").cast("long").alias("n_lines"),
        F.regexp_count(raw, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count(raw, F.lit(r"[!?]")).cast("long").alias("n_marks"),
        F.regexp_count(raw, F.lit(r"[0-9]")).cast("long").alias("n_digits"),
    )
    return df.withColumn("q", q).drop("q_words", "q_lines", "q_windows", "q_ranked", "q_again")


def share(part: str, whole: str) -> Column:
    return F.col(f"q.{part}") / F.greatest(F.col(f"q.{whole}"), F.lit(1))


def vote(value: Column, good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """The votes.  A rule abstains between its two thresholds."""
    words_, length = F.col("q.n_words"), share("word_chars", "n_words")
    symbols, lines, repeats = share("n_symbols", "n_words"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words")
    upper, marks, digits = share("n_upper", "word_chars"), share("n_marks", "n_words"), share("n_digits", "word_chars")
    return {
        "long_enough": vote(words_, words_ >= 80, words_ < 50),
        "word_length": vote(length, length.between(3, 9), (length < 2.5) | (length > 12)),
        "few_symbols": vote(symbols, symbols <= 0.03, symbols > 0.15),
        "few_same_lines": vote(lines, lines <= 0.1, (lines > 0.3) & (F.col("q.n_dup_lines") >= 3)),
        "few_repeats": vote(repeats, repeats <= 0.15, repeats > 0.4),
        "few_capitals": vote(upper, upper <= 0.2, upper > 0.45),
        "few_marks": vote(marks, marks <= 0.1, marks > 0.3),
        "few_digits": vote(digits, digits <= 0.1, digits > 0.3),
    }


def fit(patterns: dict[tuple[int, ...], int], names: list[str], rounds: int = ROUNDS) -> dict:
    """Expectation-maximisation over (pattern of votes: documents): the share of good documents, and how often each rule, when it votes,
    votes bad on good and on bad documents.

    The start takes any bad vote as the sign of a bad document, but for rules that vote bad on most documents: those tell nothing yet.
    An abstention is no evidence.  Of good documents each rule is taken to have
    voted good on a further share PRIOR of all: where the counts can't tell (a single rule that ever votes bad fits any split of the
    classes) this decides, alike at every size.  Half a vote for each side keeps estimates within (0, 1); nothing else bounds them.
    Rounds end when the likelihood stays the same.
    """
    rows, n = list(patterns), [patterns[r] for r in patterns]
    often = [sum(a * r[j] for a, r in zip(n, rows, strict=True)) < 0 for j in range(len(names))]
    good = [0.05 if any(v < 0 and not o for v, o in zip(r, often, strict=True)) else 0.97 for r in rows]
    model = {"good": 0.5, "votes": {x: {"good": 0.01, "bad": 0.5} for x in names}, "rounds": 0, "converged": not rows}
    before = None
    while rows and model["rounds"] < rounds and not model["converged"]:
        share = {"good": [a * p for a, p in zip(n, good, strict=True)], "bad": [a * (1 - p) for a, p in zip(n, good, strict=True)]}
        rates: dict[str, dict[str, float]] = {}
        for j, x in enumerate(names):
            tally = {side: [sum(a for a, r in zip(own, rows, strict=True) if r[j] == v) for v in (-1, 1)] for side, own in share.items()}
            rates[x] = {side: (down + 0.5) / (down + up + 1 + (PRIOR * sum(n) if side == "good" else 0)) for side, (down, up) in tally.items()}
        model |= {"good": (sum(share["good"]) + 1) / (sum(n) + 2), "votes": rates, "rounds": model["rounds"] + 1}
        total = 0.0
        for i, r in enumerate(rows):
            a, b = (math.log(s) + sum(math.log(rates[x][side] if v < 0 else 1 - rates[x][side]) for x, v in zip(names, r, strict=True) if v) for side, s in (("good", model["good"]), ("bad", 1 - model["good"])))
            good[i] = 1 / (1 + math.exp(min(700.0, b - a)))
            total += n[i] * (max(a, b) + math.log1p(math.exp(-abs(a - b))))
        model["converged"] = before is not None and abs(total - before) <= 1e-9 * abs(total)
        before = total
    return model


def posterior(model: dict, votes: dict[str, Column]) -> Column:
    terms = []
    for x, v in votes.items():
        good, bad = model["votes"][x]["good"], model["votes"][x]["bad"]
        terms.append(F.when(v == -1, math.log(good / bad)).when(v == 1, math.log((1 - good) / (1 - bad))).otherwise(0.0))
    return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, terms, F.lit(math.log(model["good"] / (1 - model["good"]))))))


def judged(docs: DataFrame, text: str = "text", columns: list[str] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """The named columns of ``docs`` (all by default) with ``q`` (the counts), base_failed, quality (posterior) and kept.

    Texts are read once: the counts are written beside the columns that stay, and the model is fitted on that table.
    """
    names = list(rules())
    columns = docs.columns if columns is None else columns
    scratch = Scratch(docs.sparkSession, "quality")
    slim = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]).alias("row"), F.col(text).alias("text"))
    counted = scratch.table(counts(slim).select("row", "q"), "counted")
    failed = (F.col("q.n_words") < 50) | (100 * F.col("q.n_repeat_words") > 50 * F.col("q.n_words"))
    # At most 3 ** len(names) rows, whatever the input.
    patterns = counted.where(~failed).select(*[c.alias(x) for x, c in rules().items()]).groupBy(*names).agg(F.count("*").alias("n"))
    model = fit({tuple(r[:-1]): r[-1] for r in patterns.collect()}, names, rounds)
    return (
        counted.withColumn("base_failed", failed)
        .withColumn("quality", posterior(model, rules()))
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP_AT))
    )


def row_columns(columns: list[str]) -> list[Column]:
    return [F.col(f"row.c{i}").alias(c) for i, c in enumerate(columns)]


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    return judged(docs, text).where("kept").select(*row_columns(docs.columns))
