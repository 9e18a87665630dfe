"""Language-model scores by a hidden Markov model trained with Baum-Welch over all training documents.

A token is a lower-cased word; one end token closes each document.  The states emit classes: frequent words are a class of their
own each, the others share SUFFIXES classes by the last two bytes of the word, and the end has one.  The frequent words are those
above a count that leaves PER_ROOT for each unit of the square root of the training tokens, so their number grows as vocabularies
do (Heaps' law); the count comes from a histogram of counts, so nothing is sorted in one task.  Within a class a
word has its smoothed unigram share, and each suffix class holds 0.5 for all words never seen together: the model is a
distribution over texts in which such words are not told apart within a class.  What the states emit goes to every task: 64 bytes
for a frequent word and 8 states, some 2 MB for 80 million tokens and some 900 MB for 10 ** 13.  The word counts are never broadcast: what
documents hold beyond the frequent words is joined with the counts by hash, as one row for each document and word.

Training: each partition runs the scaled forward-backward recursion over its documents, many at once, and returns expected
counts by class; Spark adds them up, the driver holds parameters only.  Whole documents are recursed over: where they have
more than PIECE_TOKENS tokens together the forward variables are kept at the ends of pieces and made again in between.  Rounds end when a token's mean log10
probability gains less than GAIN, or after ROUNDS.  Scoring runs the scaled forward recursion over the whole sequence.

Words are compared by 64 bits: 56 of a hash and 8 of the suffix class.  Nulls: a null text is empty and has just the end token; a null id is crc32 of the empty
text.  Repeated rows are scored each and counted each.  Without training rows counts are 0 and every class is equally likely.
Other columns are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fold
from .textscan import _ODD, lowered, mix, span_hashes, text_bytes, word_spans

PER_ROOT = 4.0
#: A power of two: a word's hash holds its suffix class in the lowest bits.
SUFFIXES = 256
STATES = 8
ROUNDS = 6
#: A gain that no longer matters: scores are sums of log10 over tokens of about -3 each.
GAIN = 0.02
STAY = 0.9
PRIOR = 200.0
FOLDS, HELD_OUT = 5, 1
#: Tokens recursed over together, those of them whose variables are held at once, and tokens held (four bytes each) to sort documents
#: by length.
GROUP_TOKENS, PIECE_TOKENS, HELD_TOKENS = 1 << 21, 1 << 18, 1 << 22
#: Distinct words of a partition whose counts are held.
HELD_WORDS = 1 << 20
#: Rows cut into words together, and bytes of their texts (or one text).
CUT_ROWS, CUT_BYTES = 1000, 1 << 24


_SUFFIX = (mix(np.arange(1 << 16, dtype=np.uint64) * _ODD) % np.uint64(SUFFIXES)).astype(np.int16)


def cuts(column: pa.Array) -> Iterator[tuple[int, int]]:
    """First row and number of rows of successive slices with at most CUT_ROWS rows and CUT_BYTES bytes, or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(ends):
        before = ends[first - 1] if first else 0
        stop = max(first + 1, min(first + CUT_ROWS, int(np.searchsorted(ends, before + CUT_BYTES, "right"))))
        yield first, stop - first
        first = stop


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, suffix classes, and for each text the index of its first word (one entry more)."""
    raw, at = text_bytes(column)
    raw = lowered(raw)
    starts, ends, firsts = word_spans(raw, at)
    # A word of one byte has no byte before its last; 0 never occurs inside a word's suffix otherwise.
    before = raw[np.maximum(ends - 2, 0)].astype(np.uint16) * (ends - starts > 1)
    suffix = _SUFFIX[before << np.uint16(8) | raw[ends - 1]]
    return span_hashes(raw, starts, ends) & ~np.uint64(SUFFIXES - 1) | suffix.astype(np.uint64), suffix, firsts


def runs(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1]]))


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, n: counts of a partition, put out whenever merging leaves more than half of HELD_WORDS."""
    some, size = [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        words, n = (np.concatenate(x) for x in zip(*some, strict=True))
        order = np.argsort(words)
        words = words[order]
        at = runs(words)
        return words[at], np.add.reduceat(n[order], at) if len(at) else n

    for batch in batches:
        for at, rows in cuts(batch.column(0)):
            h = np.sort(tokens(batch.column(0).slice(at, rows))[0])
            first = runs(h)
            some.append((h[first], np.diff(np.append(first, len(h)))))
            size += len(first)
            if size > HELD_WORDS:
                some = [merged()]
                size = len(some[0][0])
                if size > HELD_WORDS // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(some[0][0].view(np.int64)), pa.array(some[0][1])], ["word", "n"])
                    some, size = [], 0
    if some:
        words, n = merged()
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["word", "n"])


class Vocabulary:
    """The most frequent words, as (hash, count), with class sizes and totals."""

    def __init__(self, top: list[tuple[int, int]] | np.ndarray, suffix_mass: dict[int, float], total: int, distinct: int, ends: int):
        words, counts = np.array(top, np.int64).reshape(-1, 2).T.copy()
        order = np.argsort(words.view(np.uint64))
        self.words, self.counts = words.view(np.uint64)[order], counts[order]
        self.total, self.distinct, self.ends = total + ends, distinct + (ends > 0), ends
        self.k, self.first = len(self.words), None
        self.mass = np.concatenate([self.counts + 0.5, np.array([suffix_mass.get(i, 0.0) + 0.5 for i in range(SUFFIXES)]), [ends + 0.5]])
        self.size = len(self.mass)
        self.base = self.mass / self.mass.sum()
        self.denominator = self.total + 0.5 * (self.distinct + 1)
        self.base_log = np.log10((np.concatenate([self.counts, np.zeros(SUFFIXES), [ends]]) + 0.5) / self.denominator)

    def classes(self, hashes: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
        """Classes of words.  Words are in order of their evenly spread hashes, so the leading bits tell where to look."""
        out = suffixes.astype(np.int64) + self.k
        if not self.k:
            return out
        shift = np.uint64(64 - self.k.bit_length())
        if self.first is None:
            self.first = np.searchsorted(self.words >> shift, np.arange((1 << self.k.bit_length()) + 1, dtype=np.uint64))
        leading = (hashes >> shift).astype(np.int64)
        at, stop = self.first[leading], self.first[leading + 1]
        left = np.flatnonzero(at < stop)
        while len(left):
            here = at[left]
            hit = self.words[here] == hashes[left]
            out[left[hit]] = here[hit]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < stop[left]]
        return out


def encoder(v: Vocabulary):
    """Rows: id, held_out, n_tokens, sequence (classes as unsigned 32-bit), top_base, top_known, other words with counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        serial = TaskContext.get().partitionId() << 40
        for batch in batches:
            for start, size in cuts(batch.column(2)):
                part = batch.slice(start, size)
                h, s, firsts = tokens(part.column(2))
                c = v.classes(h, s)
                of = np.repeat(np.arange(size), np.diff(firsts))
                frequent = c < v.k
                base = np.bincount(of[frequent], v.base_log[c[frequent]], size) + v.base_log[-1]
                known = np.bincount(of[frequent], minlength=size) + (v.ends > 0)
                sequence = np.full(len(c) + size, v.size - 1, "<u4")
                sequence[np.arange(len(c)) + of] = c
                bounds = firsts + np.arange(size + 1)
                offsets = pa.py_buffer((4 * bounds).astype(np.int32))
                # Other words of each row: rows and ranks of words are sorted as one number.
                u, rank = np.unique(h[~frequent], return_inverse=True)
                pairs = np.sort(of[~frequent] * len(u) + rank)
                first = runs(pairs)
                row, rank = np.divmod(pairs[first], max(1, len(u)))
                lists = pa.array(np.searchsorted(row, np.arange(size + 1)), pa.int32())
                n = np.diff(np.append(first, len(pairs)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(serial, serial + size)), part.column(0), part.column(1), pa.array(np.diff(bounds)),
                        pa.Array.from_buffers(pa.binary(), size, [None, offsets, pa.py_buffer(sequence)]), pa.array(base), pa.array(known),
                        pa.ListArray.from_arrays(lists, pa.array(u[rank].view(np.int64))), pa.ListArray.from_arrays(lists, pa.array(n)),
                    ],
                    ["row", "doc_id", "held_out", "n_tokens", "sequence", "top_base", "top_known", "words", "counts"],
                )
                serial += size

    return run


def start_model(v: Vocabulary, states: int) -> dict:
    """States begin near the unigram shares, tilted by a fixed hash of (class, state)."""
    key = np.arange(v.size, dtype=np.uint64)[:, None] * np.uint64(states) + np.arange(states, dtype=np.uint64) + np.uint64(1)
    tilt = (mix(key * _ODD) >> np.uint64(11)).astype(float) / float(1 << 53)
    emit = v.base[:, None] * np.exp(tilt)
    move = np.full((states, states), (1 - STAY) / max(1, states - 1))
    np.fill_diagonal(move, STAY if states > 1 else 1.0)
    return {"start": np.full(states, 1 / states), "move": move, "emit": emit / emit.sum(0)}


def groups(sequences: list[np.ndarray]) -> Iterator[list[int]]:
    """Indices of sequences, the longest first, with GROUP_TOKENS tokens together at most (or one sequence)."""
    some, size = [], 0
    for i in sorted(range(len(sequences)), key=lambda i: -len(sequences[i])):
        if some and size + len(sequences[i]) > GROUP_TOKENS:
            yield some
            some, size = [], 0
        some.append(i)
        size += len(sequences[i])
    if some:
        yield some


def by_time(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Classes at the first token of all sequences, then at the second ..., and where each time begins (one entry more than times).
    Sequences are given longest first, so those that still run are the first ones at every time."""
    lengths = np.array([len(x) for x in sequences])
    at = np.concatenate([[0], np.cumsum(np.searchsorted(-lengths, -np.arange(lengths[0]), "left"))])
    place = at[np.arange(at[-1], dtype=np.int32) - np.repeat((np.cumsum(lengths) - lengths).astype(np.int32), lengths)]
    place += np.repeat(np.arange(len(sequences), dtype=np.int32), lengths)
    seen = np.empty(at[-1], np.int64)
    seen[place] = np.concatenate(sequences)
    return seen, at


def forward(model: dict, emitted: np.ndarray, at: np.ndarray, a: np.ndarray | None, alpha: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The scaled forward variables after the times that ``at`` bounds, and the scales; ``alpha`` takes those of every time.
    A state is a row everywhere, so that each step goes along the sequences."""
    start, back = model["start"][:, None], np.ascontiguousarray(model["move"].T)
    ones, scale = np.ones(len(start), emitted.dtype), np.empty(emitted.shape[1], emitted.dtype)
    for low, high in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        e = emitted[:, low:high]
        if a is None:
            a = e * start
        else:
            a = back @ (a if a.shape[1] == high - low else a[:, : high - low])
            a *= e
        s = np.dot(ones, a, out=scale[low:high])
        a = np.divide(a, s, out=a if alpha is None else alpha[:, low:high])
    return a, scale


def log_likelihoods(model: dict, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 of each sequence's probability, by the scaled forward recursion."""
    out = np.zeros(len(sequences))
    emit = np.ascontiguousarray(model["emit"].T)
    for some in groups(sequences):
        seen, at = by_time([sequences[i] for i in some])
        a, logs = None, np.zeros(len(some))
        for first, stop in pieces_of(at, PIECE_TOKENS):
            here = at[first : stop + 1] - at[first]
            a, scale = forward(model, np.take(emit, seen[at[first] : at[stop]], 1), here, a)
            logs += np.bincount(np.arange(here[-1]) - np.repeat(here[:-1], np.diff(here)), np.log10(scale), len(some))
        out[some] = logs
    return out


def pieces_of(at: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Successive times as (first, stop) with about ``size`` tokens together."""
    out, first = [], 0
    while first < len(at) - 1:
        stop = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
        out.append((first, stop))
        first = stop
    return out


def expected(model: dict, sequences: list[np.ndarray], piece: int = PIECE_TOKENS, total: dict | None = None) -> dict:
    """Expected counts of starts, moves and emissions (classes by states), and the sum of log10 probabilities, added to ``total``.
    The recursion has the precision of ``model``, the sums have eight bytes."""
    move, emit = model["move"], np.ascontiguousarray(model["emit"].T)
    k, size = emit.shape
    # Emissions lie state by state: the cost of a group goes by its tokens, not by the number of classes.
    total = total or {"start": np.zeros(k), "move": np.zeros((k, k)), "emit": np.zeros((k, size)).T, "log": 0.0}
    for some in groups(sequences):
        seen, at = by_time([sequences[i] for i in some])
        cuts, before = pieces_of(at, piece), [None]
        for first, stop in cuts[:-1]:
            before.append(forward(model, np.take(emit, seen[at[first] : at[stop]], 1), at[first : stop + 1] - at[first], before[-1])[0])
        beta, moves = np.ones((k, len(some)), emit.dtype), np.zeros((k, k))
        for (first, stop), earlier in zip(reversed(cuts), reversed(before), strict=True):
            classes, here = seen[at[first] : at[stop]], at[first : stop + 1] - at[first]
            ahead = np.take(emit, classes, 1)
            alpha = np.empty_like(ahead)
            _, scale = forward(model, ahead, here, earlier, alpha)
            total["log"] += float(np.log10(scale).sum(dtype=float))
            ahead /= scale
            bounds = here.tolist()
            for t in range(stop - first - 1, -1, -1):
                low, high = bounds[t], bounds[t + 1]
                n = high - low
                x, now, behind = ahead[:, low:high], alpha[:, low:high], beta[:, :n]
                x *= behind
                now *= behind
                prior = alpha[:, bounds[t - 1] : bounds[t - 1] + n] if t else earlier
                if prior is not None:
                    moves += prior[:, :n] @ x.T
                    np.matmul(move, x, out=behind)
            if not first:
                total["start"] += alpha[:, : here[1]].sum(1, dtype=float)
            for s in range(k):
                np.add.at(total["emit"][:, s], classes, alpha[s].astype(float))
        total["move"] += moves * move
    return total


def sequences_of(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u4") for x in column.to_pylist()]


def held(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.Table, list[np.ndarray]]]:
    """Rows of about HELD_TOKENS tokens together, and their sequences: many at once, since a step costs much the same for one."""
    some, size = [], 0
    for batch in batches:
        some.append(batch)
        size += batch.column(column).nbytes // 4
        if size >= HELD_TOKENS:
            table = pa.Table.from_batches(some)
            yield table, sequences_of(table.column(column))
            some, size = [], 0
    if some:
        table = pa.Table.from_batches(some)
        yield table, sequences_of(table.column(column))


def train(encoded: DataFrame, v: Vocabulary, states: int = STATES, rounds: int = ROUNDS) -> dict:
    """Baum-Welch with a prior of PRIOR unigram tokens for each state; expected counts come back as one row for each class."""
    model = start_model(v, states)
    model["emit"] = np.asfortranarray(model["emit"])
    names = [f"s{i}" for i in range(states)]
    before = None
    for _ in range(rounds):

        # Four bytes a number in the recursions of training; scores have eight.
        short = {name: x.astype(np.float32) for name, x in model.items()}

        def counts(batches: Iterator[pa.RecordBatch], model: dict = short) -> Iterator[pa.RecordBatch]:
            sums = None
            for _, sequences in held(batches, 0):
                sums = expected(model, sequences, total=sums)
            if sums:
                used = np.flatnonzero(sums["emit"].any(1))
                table = np.concatenate([sums["emit"][used], sums["move"], sums["start"][None], np.full((1, states), sums["log"])])
                places = np.concatenate([used, v.size + np.arange(states + 2)])
                yield pa.RecordBatch.from_arrays([pa.array(places), *(pa.array(np.ascontiguousarray(x)) for x in table.T)], ["place", *names])

        rows = encoded.where("not held_out").select("sequence").mapInArrow(counts, "place long, " + ", ".join(f"{x} double" for x in names))
        table = np.zeros((v.size + states + 2, states))
        summed = rows.groupBy("place").agg(*[F.sum(x).alias(x) for x in names]).toArrow()
        table[summed["place"].to_numpy()] = np.stack([summed[x].to_numpy() for x in names], 1)
        emit = table[: v.size] + PRIOR * v.base[:, None]
        move = table[v.size : v.size + states] + 1.0
        first = table[-2] + 1.0
        model = {"start": first / first.sum(), "move": move / move.sum(1, keepdims=True), "emit": np.asfortranarray(emit / emit.sum(0))}
        log = table[-1, 0] / max(1, v.total)
        if before is not None and log - before < GAIN:
            break
        before = log
    return model


def scored(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", states: int = STATES, rounds: int = ROUNDS, classes: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; every row of ``docs``.

    ``classes`` bounds the frequent words; by default PER_ROOT does, and they grow with the training tokens.
    """
    scratch = Scratch(docs.sparkSession, "hidden-markov")
    slim = docs.select(F.col(doc_id).alias("doc_id"), (fold(F.col(doc_id), FOLDS) == HELD_OUT).alias("held_out"), F.col(text).alias("text"))
    learn = slim.where("not held_out")
    counts = scratch.table(learn.select("text").mapInArrow(count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    suffix_of = F.col("word").bitwiseAND(F.lit(SUFFIXES - 1)).cast("int")
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = learn.count()
    # Counts by sixteenths of a power of two: about a thousand at most.  The frequent words are those from the lowest level on that leaves
    # no more than ``classes`` of them.
    classes = int(PER_ROOT * math.sqrt(sums[0])) if classes is None else classes
    level = F.floor(16 * F.log2("n")).cast("int")
    most, least = 0, 1 << 30
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect(), reverse=True):
        most += r["words"]
        if most > classes:
            break
        least = r["level"]
    found = counts.where(level >= least).select("word", "n").toArrow()
    word, n = (found[x].to_numpy() for x in ("word", "n"))
    mass = {r[0]: float(r[1]) for r in counts.groupBy(suffix_of).agg(F.sum(F.col("n") + 0.5)).collect()}
    for k, own in enumerate(np.bincount(word & (SUFFIXES - 1), n + 0.5, SUFFIXES).tolist() if len(n) else ()):
        mass[k] = mass.get(k, 0.0) - own
    v = Vocabulary(np.stack([word, n], 1), mass, int(sums[0]), int(sums[1]), ends)
    kind = slim.schema["doc_id"].dataType.simpleString()
    encoded = slim.mapInArrow(encoder(v), f"row long, doc_id {kind}, held_out boolean, n_tokens long, sequence binary, top_base double, top_known long, words array<long>, counts array<long>")
    encoded = scratch.table(encoded, "encoded")
    model = train(encoded, v, states, rounds)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, sequences in held(batches, 6):
            logs = pa.array(log_likelihoods(model, sequences))
            yield from table.select(range(6)).append_column("classes", logs).to_batches()

    states_of = encoded.select("row", "doc_id", "held_out", "n_tokens", "top_base", "top_known", "sequence").mapInArrow(scores, f"row long, doc_id {kind}, held_out boolean, n_tokens long, top_base double, top_known long, classes double")
    others = encoded.select("row", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    known = counts.select("word", F.col("n").alias("c"))
    joined = others.join(known, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    whole = F.element_at(F.array(*[F.lit(float(x)) for x in v.mass[v.k : v.k + SUFFIXES]]), suffix_of + 1)
    per_row = joined.groupBy("row").agg(
        F.sum(F.col("n") * F.log10((F.col("c") + 0.5) / F.lit(float(v.denominator)))).alias("other_base"),
        F.sum(F.col("n") * F.log10((F.col("c") + 0.5) / whole)).alias("other_share"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("other_known"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return states_of.join(per_row, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("top_known") + zero("other_known")).cast("long").alias("n_known"),
        F.lit(int(v.total)).cast("long").alias("train_tokens"),
        (F.col("top_base") + zero("other_base")).alias("base_score"),
        (F.col("classes") + zero("other_share")).alias("score"),
    )
