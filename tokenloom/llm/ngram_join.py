"""Jaccard join on word shingles with adaptive multi-match prefixes.

Order: shingles are ordered by a frequency class and then by hash.  The class comes from a sketch of fixed size that counts the
shingles of all documents, so frequent ones (shared passages, licences) come last.  Any order gives the same result.

Prefixes: two sets of sizes n that are similar share at least l of their first n - ceil(t * n) + l shingles.  A document whose
shortest prefix (l = 1) promises many candidates takes a larger l: its prefix is that much longer, and a pair is verified only
if it shares the smaller l of its two documents.

Pairs: documents with equal sets are one node.  The nodes that share a prefix shingle form a bucket.  The most central node of
each bucket is compared with the others (a star, so a bucket costs its size), and the links found give components.  What is left
are pairs of a cell (all nodes of one hub's buckets) that are in different components: they are compared within blocks by their
bitmaps, whose distance never exceeds the sets', and only those that can still be similar come out.  Links that would join
nodes already connected are not looked for, so no group is expanded into all its pairs and no component is lost.

Shingles are compared by 64-bit hashes, sets by 128-bit digests.  Nulls: a null text counts as empty, an empty set is linked with
nothing; a null id never names a component, unless it has no other (then component_id is null).  Rows with a repeated id are
rows of their own.  Texts of any length are shingled whole; other columns are not read by the join, and dropping copies carries them
under their names.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components
from .textscan import shingles, word_hashes

SKETCH_BITS = 20
SKETCH_BLOCK = 1 << 14
SKETCH_PARTS = 64
LONGEST = 4
COST = 64.0
CELL = 2048


class Similarity:
    """Exact arithmetic on a threshold such as 9/10."""

    def __init__(self, threshold: str | float | Fraction):
        t = Fraction(str(threshold)) if not isinstance(threshold, Fraction) else threshold
        self.a, self.b = t.numerator, t.denominator

    def least_overlap(self, n: int) -> int:
        return -(-self.a * n // self.b)

    def most_apart(self, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """The largest symmetric difference of similar sets of these sizes."""
        total = n + m
        return total - 2 * (-(-self.a * total // (self.a + self.b)))


def each_set(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    for at in range(0, len(column), 1000):
        hashes, firsts = word_hashes(column.slice(at, 1000))
        for i in range(len(firsts) - 1):
            yield shingles(hashes[firsts[i] : firsts[i + 1]], k)


def frequency_classes(texts: DataFrame, k: int) -> tuple[np.ndarray, float]:
    """The class of every sketch bucket, and the documents that class 1 stands for."""
    size = 1 << SKETCH_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sums = np.zeros(size, np.uint32)
        for batch in batches:
            sets = list(each_set(batch.column(0), k))
            if sets:
                sums += np.bincount((np.concatenate(sets) & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint32)
        blocks = [zlib.compress(sums[i : i + SKETCH_BLOCK].tobytes(), 1) for i in range(0, size, SKETCH_BLOCK)]
        # Sketches are added in two steps: those of partitions with a number in common, then these sums.
        part = TaskContext.get().partitionId() % SKETCH_PARTS
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([part] * len(blocks), pa.int32()), pa.array(blocks, pa.binary())], ["block", "part", "data"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(x), np.uint32).astype(np.uint64) for x in rows["data"])
        data = zlib.compress(np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes(), 1)
        return pd.DataFrame({"block": rows["block"][:1], "part": rows["part"][:1], "data": [data]})

    shape = "block int, part int, data binary"
    rows = texts.mapInArrow(count, shape).groupBy("block", "part").applyInPandas(add, shape).groupBy("block").applyInPandas(add, shape).collect()
    counts = np.zeros(size)
    for r in rows:
        counts[r["block"] * SKETCH_BLOCK : (r["block"] + 1) * SKETCH_BLOCK] = np.frombuffer(zlib.decompress(r["data"]), np.uint32)
    load = float(np.median(counts))
    unit = max(8.0, 4 * load**0.5)
    return np.floor(np.log2(np.maximum(counts - load, 0) / unit + 1)).astype(np.uint8), unit


def bitmap(values: np.ndarray) -> bytes:
    """Parity bits of the hashes; as many as shingles, a power of two from 256 to 65536."""
    size = 1 << min(16, max(8, int(len(values)).bit_length()))
    odd = np.bincount((values >> np.uint64(40)).astype(np.int64) & (size - 1), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """A bitmap of bytes brought to a smaller size; the parity of a union of buckets is the sum of theirs."""
    while len(bits) > size:
        half = len(bits) // 2
        bits = bits[:half] ^ bits[half:]
    return bits


def index_rows(k: int, similarity: Similarity, classes: np.ndarray, unit: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = np.uint64(len(classes) - 1)
        for batch in batches:
            rows = []
            for values in each_set(batch.column(1), k):
                n = len(values)
                if not n:
                    rows.append((b"", 0, 1, 0.0, [], b""))
                    continue
                kind = classes[(values & size).astype(np.int64)]
                order = np.argsort(kind, kind="stable")
                load = np.where(kind > 0, unit * (2.0**kind - 1), 0.0)
                need = similarity.least_overlap(n)
                cost = load[order[: n - need + 1]].sum()
                match = min(LONGEST, need, 1 + int(np.log2(1 + cost / COST)))
                rows.append((hashlib.blake2b(values.tobytes(), digest_size=16).digest(), n, match, float(load.mean()), values[order[: n - need + match]].view(np.int64), bitmap(values)))
            if rows:
                digest, n, match, central, prefix, bits = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(digest, pa.binary()), pa.array(n, pa.int64()), pa.array(match, pa.int32()), pa.array(central), pa.array(prefix, pa.list_(pa.int64())), pa.array(bits, pa.binary())],
                    ["doc_id", "digest", "n", "matches", "central", "prefix", "bits"],
                )

    return run


def close_enough(similarity: Similarity):
    """Whether the bitmaps and sizes of two sets leave room for a link."""

    def run(n1: pa.Array, n2: pa.Array, b1: pa.Array, b2: pa.Array) -> pa.Array:
        room = similarity.most_apart(np.array(n1), np.array(n2))
        out = np.zeros(len(n1), bool)
        for i, (x, y, most) in enumerate(zip(b1, b2, room, strict=True)):
            x, y = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
            size = min(len(x), len(y))
            out[i] = np.bitwise_count(folded(x, size) ^ folded(y, size)).sum(dtype=np.int64) <= most
        return pa.array(out)

    return F.arrow_udf(run, "boolean")


def cell_pairs(similarity: Similarity):
    """Pairs (a, b) of a block of a cell that are in different components and can still be similar."""

    def run(rows: pa.Table) -> pa.Table:
        node, label, n = (rows.column(c).to_numpy() for c in ("node", "label", "n"))
        side, same = rows.column("side").to_numpy(), rows.column("same")[0].as_py()
        order = np.argsort(n, kind="stable")
        node, label, n, side = node[order], label[order], n[order], side[order]
        maps = [np.frombuffer(x.as_buffer(), np.uint8) for x in rows.column("bits").combine_chunks().take(pa.array(order))]
        length = np.array([len(x) for x in maps])
        stacks: dict[int, np.ndarray] = {}
        a, b = [], []
        for i in range(len(node)):
            size = int(length[i])
            # Later nodes are no smaller, so their bitmaps are no shorter: all are folded to this one's length.
            if size not in stacks:
                stacks[size] = np.stack([folded(x, size) if len(x) >= size else np.zeros(size, np.uint8) for x in maps]).view(np.uint64)
            stop = int(np.searchsorted(n, n[i] * similarity.b // similarity.a, "right"))
            j = np.arange(i + 1, stop)
            j = j[(label[j] != label[i]) & (same | (side[j] != side[i]))]
            if len(j):
                apart = np.bitwise_count(stacks[size][j] ^ stacks[size][i]).sum(axis=1, dtype=np.int64)
                j = j[apart <= similarity.most_apart(n[i], n[j])]
                a.append(np.full(len(j), node[i]))
                b.append(node[j])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    return run


def set_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(each_set(batch.column(0), k))
            digests = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else b"" for x in sets]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["digest", "items"])

    return run


def links(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, similarity: Similarity, scratch: Scratch, name: str) -> DataFrame:
    """Of pairs (a, b), those whose sets are similar: first the multi-match of prefixes, then the whole sets."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("prefix").alias(f"{x}_prefix"), F.col("matches").alias(f"{x}_matches"))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    met = met.where(F.size(F.array_intersect("a_prefix", "b_prefix")) >= F.least("a_matches", "b_matches")).select("a", "b")
    met = scratch.table(met, f"{name}-met")
    wanted = met.select("a").union(met.select("b")).distinct().toDF("node")
    wanted = scratch.table(nodes.join(wanted, "node").select("node", "digest", "doc_id"), f"{name}-wanted")
    ids = wanted.select(F.col("doc_id").alias("id")).distinct()
    texts = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").select("text")
    sets = texts.mapInArrow(set_rows(k), "digest binary, items array<long>").join(wanted.select("node", "digest"), "digest").select("node", "items").dropDuplicates(["node"])
    sets = scratch.table(sets, f"{name}-sets", "none")
    scratch.release()
    full = lambda x: sets.select(F.col("node").alias(x), F.col("items").alias(f"{x}_items"))
    shared = F.size(F.array_intersect("a_items", "b_items")).cast("long")
    union = F.size("a_items") + F.size("b_items") - shared
    sure = met.join(full("a"), "a").join(full("b"), "b").where(similarity.b * shared >= similarity.a * union).select("a", "b")
    sure = scratch.table(sure, name)
    for part in ("sets", "met", "wanted"):
        scratch.drop(f"{name}-{part}")
    scratch.release()
    return sure


def joined(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = 5, threshold: str | float | Fraction = "0.8") -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id."""
    similarity = Similarity(threshold)
    scratch = Scratch(docs.sparkSession, "ngram-join")
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    classes, unit = frequency_classes(slim.select("text"), k)
    rows = slim.mapInArrow(index_rows(k, similarity, classes, unit), f"doc_id {kind}, digest binary, n long, matches int, central double, prefix array<long>, bits binary")
    rows = scratch.table(rows, "rows")
    firsts = [F.first(c).alias(c) for c in ("n", "matches", "central", "prefix", "bits")]
    nodes = rows.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), *firsts).withColumn("node", F.monotonically_increasing_id())
    nodes = scratch.table(nodes, "nodes")
    rows = scratch.table(rows.select("doc_id", "n", "digest"), "slim")
    scratch.drop("rows")
    scratch.release()

    places = nodes.select("node", "central", F.explode("prefix").alias("token"))
    hubs = places.groupBy("token").agg(F.max_by("node", "central").alias("hub"), F.count("*").alias("size")).where("size > 1").drop("size")
    cells = places.select("node", "token").join(hubs, "token").where("node != hub").select("hub", "node").distinct()
    cells = scratch.table(cells, "cells")
    scratch.release()

    slim_nodes = nodes.select("node", "n", "bits")
    end = lambda x: slim_nodes.select(F.col("node").alias(x), F.col("n").alias(f"{x}_n"), F.col("bits").alias(f"{x}_bits"))
    star = cells.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()
    near = F.least("a_n", "b_n") * similarity.b >= F.greatest("a_n", "b_n") * similarity.a
    star = star.join(end("a"), "a").join(end("b"), "b").where(near)
    star = scratch.table(star.where(close_enough(similarity)("a_n", "b_n", "a_bits", "b_bits")).select("a", "b"), "star")
    found = links(star, nodes, slim, k, similarity, scratch, "star-links")
    labels = components(found, scratch, "star-labels")

    member = cells.join(labels, "node", "left").select("hub", "node", F.coalesce("label", "node").alias("label"))
    mixed = member.groupBy("hub").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size")).where("low != high").select("hub", F.ceil(F.col("size") / CELL).cast("int").alias("blocks"))
    open_ = scratch.table(member.join(mixed, "hub").join(slim_nodes, "node"), "open")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = open_.withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("hub", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "node", "label", "n", "bits", F.col("own").alias("side"), (F.col("own") == F.col("other")).alias("same"))
    rest = dealt.groupBy("hub", "x", "y").applyInArrow(cell_pairs(similarity), "a long, b long").distinct()
    rest = scratch.table(rest, "rest")
    for part in ("open", "cells", "star"):
        scratch.drop(part)
    more = links(rest, nodes, slim, k, similarity, scratch, "rest-links")
    labels = components(found.union(more), scratch, "labels")

    of_set = nodes.select("digest", "node", F.col("doc_id").alias("least")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    names = of_set.groupBy("label").agg(F.min("least").alias("component_id"))
    named = scratch.table(of_set.join(names, "label").select("digest", "component_id"), "named")
    out = rows.select("doc_id", "n", "digest").join(named, "digest", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def drop_near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = 5, threshold: str | float | Fraction = "0.8") -> DataFrame:
    """Of each component one row stays: the smallest id (null last), then the least SHA-256 of a text; rows without shingles stay.

    Rows are numbered, so neither repeated nor null ids decide about other rows.
    """
    scratch = Scratch(docs.sparkSession, "near-copies")
    row = f"row_{uuid.uuid4().hex}"
    numbered = scratch.table(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    group = joined(numbered, text, row, k, threshold).select(F.col("doc_id").alias("row"), F.col("component_id").alias("component"))
    rank = numbered.select(F.col(row).alias("row"), F.struct(F.col(doc_id).isNull(), F.col(doc_id), F.sha2(text, 256), F.col(row)).alias("rank"))
    kept = group.join(rank, "row").groupBy("component").agg(F.min_by("row", "rank").alias(row)).select(row)
    kept = scratch.table(kept, "kept")
    return numbered.join(kept, row, "left_semi").drop(row)
