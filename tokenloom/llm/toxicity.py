"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of two tiers of a lexicon (as written and after undoing obfuscation), how near its words stand to
second-person words, capitals, punctuation, digits and obfuscated words.  The lexicon is learned: over all labelled training rows
the document frequency of every normalised word and stem is counted by class, and all whose likelihood ratio is beyond chance form
it (8 bytes each, and no more than MIN_DOCUMENTS-th part of the words in toxic labelled texts).  Trees are fitted on at most SAMPLE
labelled training rows, the isotonic map on at most SAMPLE others; these two bounds are the only ones, and every document is scored
on its whole text, however long.

Nulls: a null text counts as empty; empty texts have zero features and get the score of such.  Labels that are null, or whose
id has no document, are not used; of two labels for one id the larger counts, and it counts for all rows with that id.  Where the
training rows lack a class every score is the share of toxic labels (0 without any).  Other columns are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fold
from .textscan import is_space, lowered, mix, span_hashes, text_bytes, word_spans

MIN_DOCUMENTS = 5
#: Above what millions of words reach by chance.
LEAST_Z = 6.0
STEMS = (5, 6, 7, 8)
SAMPLE = 30_000
TREES, DEPTH, RATE, BINS, LEAST = 60, 4, 0.2, 32, 20
FOLDS, HELD_OUT = 4, 2
#: Words of 64 bits in the filter that tells texts without a label before they are shuffled: at most so many rows are broadcast.
FILTER_WORDS = 1 << 17
THRESHOLD = 0.3
#: Second-person words of the languages covered.
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "sie", "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos", "tú", "ti", "tus", "usted", "ustedes", "vosotros")
#: Characters that stand for letters in disguised words.
DISGUISES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
NAMES = ("words", "strong", "strong_plain", "weak", "strong_count", "densest", "second_person", "near", "disguised", "mixed", "capitals", "shouted", "marks", "punctuation", "digits", "single")

_undo = np.arange(256, dtype=np.uint8)
for _a, _b in DISGUISES.items():
    _undo[ord(_a)] = ord(_b)
_letter = np.zeros(256, bool)
_letter[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def normal_words(raw: np.ndarray, at: np.ndarray) -> tuple:
    """Words of lower-cased bytes: starts, ends, firsts, plain hashes (trimmed of punctuation), and hashes of the
    words with disguises undone followed by those of their stems (first bytes; 0 for shorter words).

    A disguise counts only inside a word, so the punctuation around it is trimmed first.
    """
    low = lowered(raw)
    starts, ends, firsts = word_spans(low, at)
    core = _letter | np.isin(np.arange(256), [ord(x) for x in "013457@$"])
    solid = np.concatenate([[0], np.cumsum(_letter[low])])
    # The core of a word runs from its first letter to its last; a word without letters keeps its span.
    letters = np.flatnonzero(_letter[low])
    if len(letters) and len(starts):
        first = letters[np.minimum(solid[starts], len(letters) - 1)]
        last = letters[np.maximum(solid[ends] - 1, 0)] + 1
        has = solid[ends] > solid[starts]
        inner_s, inner_e = np.where(has, first, starts), np.where(has, last, ends)
    else:
        inner_s, inner_e = starts, ends
    plain = span_hashes(low, inner_s, inner_e)
    # Leading disguises (such as a digit for the first letter) belong to the word as well.
    lead = np.where((inner_s > starts) & core[low[np.maximum(inner_s - 1, 0)]], inner_s - 1, inner_s)
    undone = _undo[low]
    keep = _letter[undone] | is_space(low)
    moved = np.concatenate([[0], np.cumsum(keep)])
    begin, stop = moved[lead], moved[inner_e]
    kept = undone[keep]
    streams = [span_hashes(kept, begin, stop)]
    for size in STEMS:
        long = stop - begin > size
        stem = np.zeros(len(begin), np.uint64)
        stem[long] = mix(span_hashes(kept, begin[long], begin[long] + size) + np.uint64(size))
        streams.append(stem)
    return starts, ends, firsts, plain, streams


def features(column: pa.Array, strong: np.ndarray, weak: np.ndarray) -> np.ndarray:
    """One row of NAMES for each text; strong and weak are sorted hashes of normalised words."""
    raw, at = text_bytes(column)
    n = len(column)
    starts, ends, firsts, plain, streams = normal_words(raw, at)
    count = np.diff(firsts)
    row = np.repeat(np.arange(n), count)
    byte_row = np.repeat(np.arange(n), np.diff(at))
    per = lambda mask: np.bincount(row[mask], minlength=n).astype(float)
    chars = lambda mask: np.bincount(byte_row[mask], minlength=n).astype(float)
    hit, hit_plain, hit_weak = _any(streams, strong), _within(plain, strong) | _any(streams[1:], strong), _any(streams, weak)
    you = _within(plain, _second_person())
    words, letters = np.maximum(count, 1), np.maximum(chars(_letter[raw]), 1)
    upper = (raw >= 65) & (raw <= 90)
    up = np.concatenate([[0], np.cumsum(upper)])
    let = np.concatenate([[0], np.cumsum(_letter[raw])])
    own = let[ends] - let[starts]
    shouted = (own >= 3) & (up[ends] - up[starts] >= own)
    mixed = (own > 0) & (own < ends - starts - 1)
    # Words since the last second-person word, and until the next, in the same text.
    index = np.arange(len(starts))
    near = np.zeros(len(starts), bool)
    if you.any():
        places = np.flatnonzero(you)
        before = np.searchsorted(places, index, "right") - 1
        for k in (before, before + 1):
            ok = (k >= 0) & (k < len(places))
            p = places[np.clip(k, 0, len(places) - 1)]
            near |= ok & (np.abs(p - index) <= 5) & (row[p] == row) if len(row) else ok
    running = np.concatenate([[0], np.cumsum(hit)])
    ahead = np.minimum(index + 50, firsts[row + 1]) if len(row) else index
    dense = np.zeros(n)
    np.maximum.at(dense, row, (running[ahead] - running[index]).astype(float))
    mark = (raw == 33) | (raw == 63)
    punct = ((raw >= 33) & (raw <= 47)) | ((raw >= 58) & (raw <= 64)) | ((raw >= 91) & (raw <= 96)) | ((raw >= 123) & (raw <= 126))
    digit = (raw >= 48) & (raw <= 57)
    out = [
        np.log1p(count), per(hit) / words, per(hit_plain) / words, per(hit_weak) / words, per(hit), dense, per(you) / words, per(hit & near) / words,
        per(hit & ~hit_plain) / words, per(mixed) / words, chars(upper) / letters, per(shouted) / words, chars(mark) / words, chars(punct) / words, chars(digit) / words, per(own == 1) / words,
    ]
    return np.stack(out, axis=1) if n else np.zeros((0, len(NAMES)))


def _within(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _any(streams: list[np.ndarray], known: np.ndarray) -> np.ndarray:
    return np.logical_or.reduce([_within(x, known) for x in streams])


def hashes_of(words: tuple[str, ...]) -> np.ndarray:
    raw, at = text_bytes(pa.array([" ".join(words)]))
    return np.unique(normal_words(raw, at)[3])


_you: list[np.ndarray] = []


def _second_person() -> np.ndarray:
    if not _you:
        _you.append(hashes_of(SECOND_PERSON))
    return _you[0]


# Trees ---------------------------------------------------------------------------------------------------------------------


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> dict:
    """Second-order boosting of the logistic loss on histograms; complete trees, as arrays by level order."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    # Many features are zero in most texts, so quantiles of their positive values are added.
    cuts = [np.unique(np.concatenate([c, np.quantile(v, np.linspace(0, 1, 9)[:-1]) * (1 - 1e-9) if len(v := x[x[:, j] > 0, j]) else c])) for j, c in enumerate(cuts)]
    width = max(len(c) for c in cuts) + 1
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    prior = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    margin, grown = np.full(len(y), prior), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), int)
        feature, cut = np.zeros(2**depth - 1, int), np.full(2**depth - 1, width)
        for level in range(depth):
            base, size = 2**level - 1, 2**level
            best = np.zeros(size)
            for j in range(x.shape[1]):
                key = (node - base) * width + binned[:, j]
                gs, hs, ns = (np.bincount(key, w, size * width).reshape(size, width).cumsum(1) for w in (g, h, None))
                gt, ht, nt = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain[(ns < LEAST) | (nt - ns < LEAST)] = 0
                top = gain.argmax(1)
                better = gain[np.arange(size), top] > best + 1e-9
                best = np.where(better, gain[np.arange(size), top], best)
                feature[base : base + size][better], cut[base : base + size][better] = j, top[better]
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > cut[node])
        leaf = node - (2**depth - 1)
        value = -rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + 1)
        margin += value[leaf]
        grown.append((feature, cut, value))
    return {"cuts": cuts, "prior": prior, "trees": grown, "depth": depth}


def margins(model: dict, x: np.ndarray) -> np.ndarray:
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(model["cuts"])], axis=1)
    out, rows = np.full(len(x), model["prior"]), np.arange(len(x))
    for feature, cut, value in model["trees"]:
        node = np.zeros(len(x), int)
        for _ in range(model["depth"]):
            node = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
        out += value[node - (2 ** model["depth"] - 1)]
    return out


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: centres and values of the blocks, each value drawn slightly to the mean."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []
    for m, t in zip(margin[order], y[order], strict=True):
        blocks.append([m, float(t), 1.0])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            m2, t2, n2 = blocks.pop()
            m1, t1, n1 = blocks[-1]
            blocks[-1] = [(m1 * n1 + m2 * n2) / (n1 + n2), t1 + t2, n1 + n2]
    mean = float(y.mean()) if len(y) else 0.0
    return np.array([b[0] for b in blocks]), np.array([(b[1] + mean) / (b[2] + 1) for b in blocks])


def score_of(model: dict, x: np.ndarray) -> np.ndarray:
    if "trees" not in model:
        return np.full(len(x), model["share"])
    m = margins(model, x)
    at, value = model["isotonic"]
    # Within a block of the map the margin still orders texts.
    return np.clip(0.98 * np.interp(m, at, value) + 0.02 / (1 + np.exp(-m)), 0.0, 1.0)


# Spark ---------------------------------------------------------------------------------------------------------------------


def slices(batches: Iterator[pa.RecordBatch], rows: int = 300) -> Iterator[pa.RecordBatch]:
    """Batches of few rows: the work on bytes takes many times their size."""
    return (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows))


def learn(labelled: DataFrame) -> dict:
    """The model from (text, label, part): part 0 fits lexicon and trees, part 1 the isotonic map."""
    scratch = Scratch(labelled.sparkSession, "toxicity")
    labelled = scratch.table(labelled.where(F.col("label").isin(0, 1)).withColumn("place", F.xxhash64("text")), "labelled")
    scratch.release()

    def words_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw, at = text_bytes(batch.column(0))
            _, _, firsts, _, streams = normal_words(raw, at)
            label = np.array(batch.column(1))
            seen = [np.unique(np.concatenate([x[firsts[i] : firsts[i + 1]] for x in streams])) for i in range(batch.num_rows)]
            for t in (0, 1):
                mine = [s for s, v in zip(seen, label, strict=True) if v == t]
                word, n = np.unique(np.concatenate(mine), return_counts=True) if mine else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n * t), pa.array(n * (1 - t))], ["word", "toxic", "clean"])

    sizes = {r["part"]: (float(r["toxic"]), float(r["n"] - r["toxic"])) for r in labelled.groupBy("part").agg(F.sum("label").alias("toxic"), F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(0, (0.0, 0.0))
    if not toxic or not clean:
        return {"share": sum(x for x, _ in sizes.values()) / max(1.0, sum(map(sum, sizes.values())))}
    words = labelled.where("part = 0").select("text", "label").mapInArrow(words_seen, "word long, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    # Root of the likelihood ratio of the 2 x 2 table (word seen or not, toxic or clean).
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    part = lambda n, of: F.when(n > 0, n * F.log(n / of)).otherwise(0.0)
    share = (a + b) / (toxic + clean)
    ratio = part(a, toxic * share) + part(b, clean * share) + part(toxic - a, toxic * (1 - share)) + part(clean - b, clean * (1 - share))
    odds = F.log((a + 0.5) / (toxic + 0.5)) - F.log((b + 0.5) / (clean + 0.5))
    ranked = words.where(f"a >= {MIN_DOCUMENTS} and word != 0").select("word", F.sqrt(2 * F.greatest(ratio, F.lit(0.0))).alias("z"), odds.alias("odds"))
    top = ranked.where(f"z > {LEAST_Z} and odds > 1.5").select("word", "z").collect()
    most = max((r["z"] for r in top), default=0.0)
    tier = lambda keep: np.sort(np.array([r["word"] for r in top if keep(r["z"])], np.int64).view(np.uint64))
    model = {"strong": tier(lambda z: z >= 0.4 * most), "weak": tier(lambda z: z < 0.4 * most)}

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = features(batch.column(0), model["strong"], model["weak"])
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))], ["label", "place", "x"])

    parts = []
    for part in (0, 1):
        mine = labelled.where(F.col("part") == part)
        # The sample is cut by hashes alone and then by features, so that no task sorts texts; equal texts are interchangeable.
        last = mine.select("place").orderBy("place").limit(SAMPLE).agg(F.max("place")).first()[0]
        dealt = mine.where(F.col("place") <= last).select("text", "label", "place").mapInArrow(dense, "label int, place long, x array<double>")
        rows = dealt.orderBy("place", "label").limit(SAMPLE).collect()
        parts.append((np.array([r["x"] for r in rows]).reshape(-1, len(NAMES)), np.array([r["label"] for r in rows], float)))
    (x, y), (x2, y2) = parts
    scratch.drop("labelled")
    scratch.release()
    model |= fit_trees(x, y)
    if not len(y2):
        x2, y2 = x, y
    return model | {"isotonic": isotonic(margins(model, x2), y2)}


def with_labels(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """The inner join of (doc_id, text) and (doc_id, label), where only texts that may have a label are shuffled.

    The filter is a bitmap of hashed ids, FILTER_WORDS long however many labels there are: when it fills up it lets more texts
    through, and the join, which is exact, drops them.  The join is the same at every size.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_WORDS * 64))
    word, bit = F.shiftright(place, 6), F.pmod(place, F.lit(64)).cast("int")
    bitmap = labels.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bit"))
    bitmap = bitmap.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    likely = texts.select("doc_id", "text", word.alias("word"), bit.alias("bit")).join(F.broadcast(bitmap), "word")
    likely = likely.where(F.getbit("bits", "bit") == 1).select("doc_id", "text")
    return likely.hint("merge").join(labels, "doc_id")


def scored(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted, for every row of ``docs``; labels whose fold is HELD_OUT are never read."""
    part = fold(F.col("doc_id"), FOLDS)
    mine = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & (part != HELD_OUT))
    mine = mine.groupBy("doc_id").agg(F.max("label").alias("label"))
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(part != HELD_OUT)
    model = learn(with_labels(texts, mine).select("text", "label", (part == 3).cast("int").alias("part")))
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for few in slices(batches):
            x = features(few.column(1), model.get("strong", np.zeros(0, np.uint64)), model.get("weak", np.zeros(0, np.uint64)))
            yield pa.RecordBatch.from_arrays([few.column(0), pa.array(score_of(model, x))], ["doc_id", "score"])

    out = slim.mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
