"""Removal of repeated byte strings with suffix arrays.

Every string of LENGTH bytes is assigned to one anchor inside it: the GRAM-byte substring with the least hash, the rightmost of
equals.  The choice depends on the string's bytes alone, so two equal strings have equal anchors at equal places, and only
anchors that occur more than once can hold a repeat.  Their surroundings (the strings assigned to one occurrence, as one segment)
go to shards by anchor.  Equal segments meet as one row with a count before that.

In a shard, a suffix array over its segments is built by Larsson-Sadakane refinement (ranks of doubled prefixes, re-sorting only
groups that are still equal) and Kasai's common prefixes are taken in lockstep over blocks of positions; a string is a repeat if
it shares LENGTH bytes with a neighbour, or its segment occurs twice.  Anchors with more segments than SPREAD are dealt over
shards; their strings that are unique in a shard are merged across shards: digests range over partitions, and each shard's sorted
run is looked up in the others' by binary search.

Texts are compared as distinct texts (by SHA-256): a text of LENGTH bytes or more with a second copy goes whole, and one copy
stands for all when others are searched.  Nulls: a null text counts as empty.  Texts shorter than LENGTH lose nothing.  Repeated
rows and ids give a row each; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_or_empty
from .textscan import _BYTE, mix, powers, text_bytes

LENGTH = 200
GRAM = 32
SAMPLE = 10
SPREAD = 2048
SHARD_BYTES = 1 << 18
SCAN_BYTES = 1 << 18


# Anchors -------------------------------------------------------------------------------------------------------------------


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """The hash of the gram at each position where one fits."""
    n = len(raw) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=total[1:])
    return mix((total[gram:] - total[:n]) * down[:n])


def anchors(raw: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Row, hash, first and last start (within raw) of the strings of each anchor.

    Few positions have hashes below a bound, and where a string holds one, its anchor is among them; rows with a string that
    holds none are searched again with all positions.
    """
    sizes = np.diff(at)
    if not (sizes >= length).any():
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    hashes = gram_hashes(raw, gram)
    bound = np.uint64((1 << 64) // SAMPLE)
    position = np.flatnonzero(hashes < bound)
    found = _assigned(position, hashes, at, length, gram)
    got = np.bincount(found[0], found[3] - found[2] + 1, len(sizes)).astype(np.int64)
    lacking = np.flatnonzero(got < np.maximum(sizes - length + 1, 0))
    if not len(lacking):
        return found
    keep = ~np.isin(found[0], lacking)
    position = np.concatenate([np.arange(at[i], at[i + 1] - gram + 1) for i in lacking])
    again = _assigned(position, hashes, at, length, gram)
    return tuple(np.concatenate([x[keep], y]) for x, y in zip(found, again, strict=True))


def _assigned(position: np.ndarray, hashes: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    row = np.searchsorted(at, position, "right") - 1
    fits = (position + gram <= at[row + 1]) & (at[row + 1] - at[row] >= length)
    position, row = position[fits], row[fits]
    value, n, reach = hashes[position], len(position), length - gram
    low = np.maximum(position - reach, at[row])
    high = np.minimum(position, at[row + 1] - length)
    left_open, right_open = np.ones(n, bool), np.ones(n, bool)
    for d in range(1, min(4, n)):  # the nearest few, as whole arrays: most candidates end here
        near = (position[d:] - position[:-d] <= reach) & (row[d:] == row[:-d])
        less = near & left_open[d:] & (value[:-d] < value[d:])
        low[d:][less] = position[:-d][less] + 1
        left_open[d:] &= ~less
        less = near & right_open[:-d] & (value[d:] <= value[:-d])
        high[:-d][less] = np.minimum(high[:-d][less], position[d:][less] - reach - 1)
        right_open[:-d] &= ~less
    alive = low <= high
    active, d = np.flatnonzero(alive & left_open), 3
    while len(active):  # a smaller hash to the left takes the strings that hold it
        d += 1
        active = active[active >= d]
        active = active[position[active - d] >= low[active]]
        less = value[active - d] < value[active]
        low[active[less]] = position[active[less] - d] + 1
        active = active[~less]
    active, d = np.flatnonzero(alive & right_open), 3
    while len(active):  # to the right, an equal one as well
        d += 1
        active = active[active + d < n]
        active = active[(position[active + d] <= position[active] + reach) & (row[active + d] == row[active])]
        less = value[active + d] <= value[active]
        high[active[less]] = np.minimum(high[active[less]], position[active[less] + d] - reach - 1)
        active = active[~less]
    keep = low <= high
    return row[keep], value[keep], low[keep], high[keep]


def row_groups(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Successive rows of about SCAN_BYTES bytes: index of the first, their bytes, where each begins."""
    raw, at = text_bytes(column)
    first = 0
    while first < len(at) - 1:
        stop = max(first + 1, int(np.searchsorted(at, at[first] + SCAN_BYTES, "right")) - 1)
        yield first, raw[at[first] : at[stop]], at[first : stop + 1] - at[first]
        first = stop


# Suffix arrays -------------------------------------------------------------------------------------------------------------


def suffix_array(data: np.ndarray, stop: np.ndarray, enough: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the order of their suffixes, and ranks, by the first ``enough`` bytes at least; a suffix ends at its ``stop``.

    Larsson-Sadakane: groups of equal prefixes of h bytes are split by the rank of what follows them.  Ties keep the rank of their
    group.  A suffix that ends is before all that go on.
    """
    n = len(data)
    room = stop - np.arange(n)
    padded = np.concatenate([data.astype(np.uint64), np.zeros(8, np.uint64)])
    key = np.zeros(n, np.uint64)
    for i in range(7):
        key = (key << np.uint64(8)) | np.where(room > i, padded[i : i + n], 0)
    key = (key << np.uint64(8)) | np.minimum(room, 7).astype(np.uint64)
    order = np.argsort(key, kind="stable").astype(np.int32)
    sorted_key = key[order]
    rank = np.empty(n, np.int32)

    def heads(changed: np.ndarray) -> np.ndarray:
        """The first place of the group that each place is in."""
        return np.maximum.accumulate(np.where(changed, np.arange(len(changed)), 0))

    first = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    rank[order] = heads(first)
    h = 7
    while h < enough:
        group = rank[order]
        same = np.concatenate([group[1:] == group[:-1], [False]])
        places = np.flatnonzero(same | np.concatenate([[False], same[:-1]]))
        if not len(places):
            break
        who = order[places]
        follow = np.where(room[who] > h, rank[np.minimum(who + h, n - 1)] + 1, 0)
        again = np.argsort(group[places].astype(np.int64) * (n + 2) + follow, kind="stable")
        who, follow = who[again], follow[again]
        order[places] = who
        g = group[places]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (follow[1:] != follow[:-1])])
        rank[who] = places[heads(new)]
        h *= 2
    return order, rank


def common_prefixes(data: np.ndarray, stop: np.ndarray, order: np.ndarray, enough: int, block: int = 64) -> np.ndarray:
    """For each position, the bytes (up to ``enough``) that its suffix shares with the one before it in ``order``.

    Kasai: the common prefix shrinks by at most one from a position to the next.  Blocks of positions go in lockstep.
    """
    n = len(data)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    before = np.where(place > 0, order[place - 1], -1)
    out = np.zeros(n, np.int64)
    words = np.zeros(n + 16, np.uint64)
    wide = np.concatenate([data, np.zeros(16, np.uint8)])
    for i in range(8):
        words |= np.concatenate([wide[i:], np.zeros(i, np.uint8)]).astype(np.uint64) << np.uint64(8 * i)
    for r in range(block):
        here = np.arange(r, n, block)
        there = before[here]
        held = np.maximum(out[here - 1] - 1, 0) if r else np.zeros(len(here), np.int64)
        most = np.where(there >= 0, np.minimum(np.minimum(stop[here] - here, stop[there] - there), enough), 0)
        held = np.minimum(held, most)
        active = np.flatnonzero(held < most)
        while len(active):
            x = words[here[active] + held[active]] ^ words[there[active] + held[active]]
            same = np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) // 8).astype(np.int64)
            held[active] = np.minimum(held[active] + same, most[active])
            active = active[(same == 8) & (held[active] < most[active])]
        out[here] = held
    return out


def repeated_starts(segments: list[bytes], counts: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each segment, whether each of its strings of ``length`` bytes starts elsewhere in the segments too.

    Suffixes that share ``length`` bytes lie next to each other, so a common prefix with either neighbour tells.
    """
    sizes = np.array([len(x) for x in segments])
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(segments), np.uint8)
    stop = np.repeat(ends, sizes)
    # Kasai's bound needs the whole order, so refinement goes on to the longest segment's end.
    order, _ = suffix_array(data, stop, int(sizes.max()))
    shared = common_prefixes(data, stop, order, length) >= length
    hit = shared.copy()
    follows = np.flatnonzero(shared[order])
    hit[order[follows - 1]] = True
    return [hit[e - s : e - length + 1] | (c > 1) for s, e, c in zip(sizes, ends, counts, strict=True)]


def runs(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.diff(np.concatenate([[0], marks.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


# Spark ---------------------------------------------------------------------------------------------------------------------


def anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """anchor, place (hash of text and position), key, low: key is the SHA-256 of the text."""
    for batch in batches:
        keys = batch.column(0)
        for first, raw, at in row_groups(batch.column(1)):
            row, value, low, _ = anchors(raw, at)
            own = keys.slice(first, len(at) - 1)
            own64 = np.array([int.from_bytes(x[:8], "little") for x in own.to_pylist()], np.uint64)
            low = low - at[row]
            place = mix(own64[row] + low.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(1)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(place.astype(np.int64)), own.take(pa.array(row)), pa.array(low)], ["anchor", "place", "key", "low"])


def segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (key, text, lows): the segments whose first start is among lows."""
    for batch in batches:
        keys, wanted = batch.column(0), batch.column(2)
        for first, raw, at in row_groups(batch.column(1)):
            row, value, low, high = anchors(raw, at)
            lists = wanted.slice(first, len(at) - 1)
            ask = np.concatenate([np.array(x.values, np.int64) + at[i] for i, x in enumerate(lists)]) if len(lists) else np.zeros(0, np.int64)
            mine = np.flatnonzero(np.isin(low, ask))
            if not len(mine):
                continue
            row, value, low, high = row[mine], value[mine], low[mine], high[mine]
            data = raw.tobytes()
            segments = [data[a : b + LENGTH] for a, b in zip(low, high, strict=True)]
            digests = [hashlib.blake2b(x, digest_size=16).digest() for x in segments]
            yield pa.RecordBatch.from_arrays(
                [pa.array(value.view(np.int64)), pa.array(digests, pa.binary()), keys.slice(first, len(at) - 1).take(pa.array(row)), pa.array(low - at[row]), pa.array(segments, pa.binary())],
                ["anchor", "digest", "key", "low", "segment"],
            )


def shard_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of segments in order of (anchor, shard): for each the runs of repeated starts, and digests of the strings to be merged."""
    held: list[tuple] = []
    size = 0

    def solve() -> Iterator[pa.RecordBatch]:
        # An anchor whose segments are all equal has nothing to sort: its count tells.
        _, inverse, number = np.unique(np.array([x[0] for x in held]), return_inverse=True, return_counts=True)
        several = (number[inverse] > 1) | np.array([x[5] for x in held])
        marks = [np.full(len(x[3]) - LENGTH + 1, x[4] > 1) for x in held]
        sorted_ = np.flatnonzero(several)
        if len(sorted_):
            for i, hit in zip(sorted_, repeated_starts([held[i][3] for i in sorted_], np.array([held[i][4] for i in sorted_])), strict=True):
                marks[i] = hit
        out, open_ = [], []
        for (anchor, shard, digest, segment, _, spread), hit in zip(held, marks, strict=True):
            a, b = runs(hit)
            out.append((anchor, digest, a, b))
            if spread:
                # One string for each of the shard's own copies: those already known here still serve other shards.
                strings = [hashlib.blake2b(segment[s : s + LENGTH], digest_size=16).digest() for s in range(len(hit))]
                open_ += [(anchor, digest, s, x, shard) for s, x in enumerate(strings)]
        cols = list(zip(*out, strict=True))
        n = len(out)
        none = pa.nulls(n, pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.list_(pa.int64())), pa.array(cols[3], pa.list_(pa.int64())), none, pa.nulls(n, pa.int32())], ["anchor", "digest", "starts", "ends", "string", "shard"])
        if open_:
            cols = list(zip(*open_, strict=True))
            starts = np.array(cols[2], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array([[s] for s in starts], pa.list_(pa.int64())), pa.array([[s + 1] for s in starts], pa.list_(pa.int64())), pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.int32())],
                ["anchor", "digest", "starts", "ends", "string", "shard"],
            )

    for batch in batches:
        for x in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            # A shard ends where the anchor or its part changes, so that all of a part is together.
            if held and size > SHARD_BYTES and x[:2] != held[-1][:2]:
                yield from solve()
                held, size = [], 0
            held.append(x)
            size += len(x[3])
    if held:
        yield from solve()


def merged_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (part, shard, string), in order of (part, shard, string): strings of a part that occur in two shards.

    A part is a range of digests; its shards are sorted runs.  Each run is looked up in the merge of those before it by binary
    search, and what both hold is put out.
    """
    part = shard = None
    known, run = np.zeros(0, "V16"), []

    def merge(known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mine = np.unique(np.frombuffer(b"".join(run), ">u8").reshape(-1, 2).copy().view([("a", ">u8"), ("b", ">u8")]).reshape(-1).astype([("a", "u8"), ("b", "u8")]))
        if not len(known):
            return mine, mine[:0]
        at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
        hit = known[at] == mine
        return np.sort(np.concatenate([known, mine[~hit]])), mine[hit]

    def rows(found: np.ndarray) -> pa.RecordBatch:
        data = np.stack([found["a"], found["b"]], axis=1).astype(">u8").tobytes()
        return pa.RecordBatch.from_arrays([pa.array([data[i : i + 16] for i in range(0, len(data), 16)], pa.binary())], ["string"])

    known = None
    for batch in batches:
        for p, s, x in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if (p, s) != (part, shard) and run:
                known, found = merge(known if known is not None else np.zeros(0))
                yield rows(found) if len(found) else pa.RecordBatch.from_arrays([pa.array([], pa.binary())], ["string"])
                run = []
            if p != part:
                known = None
            part, shard = p, s
            run.append(x)
    if run:
        _, found = merge(known if known is not None else np.zeros(0))
        if len(found):
            yield rows(found)


def cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (key, text, starts, ends): n_removed, n_spans and kept_sha256 of each text, and what is kept."""
    for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
        rows = []
        for text, starts, ends in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            raw = text.encode()
            cover = np.zeros(len(raw) + 1, np.int64)
            np.add.at(cover, np.array(starts, np.int64), 1)
            np.add.at(cover, np.array(ends, np.int64) + LENGTH - 1, -1)
            gone = np.cumsum(cover[:-1]) > 0
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            rows.append((int(gone.sum()), len(runs(gone)[0]), hashlib.sha256(kept).hexdigest(), kept))
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.binary())], ["key", "n_removed", "n_spans", "kept_sha256", "kept"])


def repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    scratch = Scratch(docs.sparkSession, "repeats")
    raw = text_or_empty(text)
    base = docs.select(F.col(doc_id).alias("doc_id"), F.unhex(F.sha2(raw, 256)).alias("key"), raw.alias("text"), F.octet_length(raw).cast("long").alias("n_bytes"))
    long = base.where(F.col("n_bytes") >= LENGTH)
    copied = scratch.table(long.groupBy("key").agg(F.count("*").alias("copies")).where("copies > 1"), "copied")

    found = long.select("key", "text").mapInArrow(anchor_rows, "anchor long, place long, key binary, low long")
    twice = found.groupBy("anchor").agg(F.min("place").alias("a"), F.max("place").alias("b")).where("a != b").select("anchor")
    twice = scratch.table(twice, "twice")
    scratch.release()
    lows = found.select("anchor", "key", "low").join(twice, "anchor", "left_semi").groupBy("key").agg(F.collect_set("low").alias("lows"))
    lows = scratch.table(lows, "lows")
    scratch.release()

    texts = long.select("key", "text").groupBy("key").agg(F.first("text").alias("text"))
    some = scratch.table(texts.join(lows, "key"), "texts")
    segments = scratch.table(some.select("key", "text", "lows").mapInArrow(segment_rows, "anchor long, digest binary, key binary, low long, segment binary"), "segments")
    scratch.drop("lows")
    scratch.release()

    distinct = segments.groupBy("anchor", "digest").agg(F.first("segment").alias("segment"), F.count("*").alias("n"))
    distinct = scratch.table(distinct, "distinct")
    spread = scratch.table(distinct.groupBy("anchor").agg(F.count("*").alias("m")).where(F.col("m") > SPREAD), "spread")
    parted = distinct.join(spread, "anchor", "left")
    shard = F.when(F.col("m").isNull(), 0).otherwise(F.pmod(F.xxhash64("digest"), F.ceil(F.col("m") / SPREAD))).cast("int")
    parted = parted.select("anchor", shard.alias("shard"), "digest", "segment", "n", F.col("m").isNotNull().alias("spread"))
    parted = parted.repartition("anchor", "shard").sortWithinPartitions("anchor", "shard")
    solved = scratch.table(parted.mapInArrow(shard_rows, "anchor long, digest binary, starts array<long>, ends array<long>, string binary, shard int"), "solved")
    scratch.release()
    marks = solved.where("string is null").select("anchor", "digest", "starts", "ends")
    strings = solved.where("string is not null")
    # The first bytes of a digest range it over parts small enough to merge in a task, whatever their number.
    ranged = strings.select(F.substring("string", 1, 3).alias("part"), "shard", "string").distinct()
    many = ranged.repartition("part").sortWithinPartitions("part", "shard", "string").mapInArrow(merged_rows, "string binary").distinct()
    marks = marks.unionByName(strings.join(many, "string", "left_semi").select("anchor", "digest", "starts", "ends"))

    placed = segments.select("anchor", "digest", "key", "low").join(marks, ["anchor", "digest"]).where(F.size("starts") > 0)
    moved = lambda c: F.transform(c, lambda x: x + F.col("low"))
    spans = placed.select("key", moved("starts").alias("starts"), moved("ends").alias("ends"))
    spans = spans.groupBy("key").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))
    cut = some.select("key", "text").join(spans, "key").join(copied, "key", "left_anti").select("key", "text", "starts", "ends")
    cut = cut.mapInArrow(cut_rows, "key binary, n_removed long, n_spans long, kept_sha256 string, kept binary")
    cut = scratch.table(cut.drop("kept"), "cut")
    scratch.release()

    whole = copied.select("key", F.lit(None).cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"))
    known = cut.unionByName(whole).withColumn("hit", F.lit(True))
    out = base.select("doc_id", "key", "n_bytes").join(known, "key", "left")
    nothing = F.col("hit").isNull()
    return out.select(
        "doc_id", "n_bytes",
        F.when(nothing, F.lit(0)).otherwise(F.coalesce("n_removed", "n_bytes")).cast("long").alias("n_removed"),
        F.when(nothing, F.lit(0)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
        F.when(nothing, F.lower(F.hex("key"))).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )
