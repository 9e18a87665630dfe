"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

At each position the automaton's output links give every piece that ends there.  For a file of type unigram each relaxes the
best score of that end; the result is the segmentation with the highest sum of the file's piece scores (ties: the longer last
piece).  A character without a piece costs UNKNOWN below the lowest score.

For a file of type BPE scores are merge ranks, and their sum means nothing.  What is relaxed there is the last piece of the prefix
that ends at a position: of the pieces that end there, the one whose junction with the last piece of the prefix before it is
stable, that is, merging the two pieces' characters by rank gives these two pieces again.  A merge across a junction depends on
its two pieces alone, and a prefix that ends at a junction is merged as in the whole text; so exactly one piece fits at each
position, and the result is the library's.  Junctions are judged once and remembered.

In both cases a character without a piece becomes its byte pieces, or the unknown id without them, and decoding gives the text
back.  BPE files with user-defined or unused pieces are refused.  No piece holds the space mark after another character, so words
are segmented on their own and remembered in a bounded memory; a vocabulary with such pieces is segmented over whole texts.

Nulls: a null text counts as empty and has no pieces.  Texts of any length are segmented whole, repeated rows and ids each for
themselves; an empty table gives an empty result.  Columns that are carried may have any name.  The space mark U+2581 in a text
decodes to a space.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.formats import fields
from .tokens import balanced

SPACE = "▁"
UNKNOWN = 10.0
MEMORY_BYTES = 96 << 20
MEMORY_JUNCTIONS = 1_000_000
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Segmenter:
    def __init__(self, pieces: list[tuple[int, str, float]], byte_ids: dict[int, int], unknown_id: int, prefix: bool = True, merges: bool = False):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for i, piece, score in pieces:
            self.machine.add_word(piece, (len(piece), i, score))
        if pieces:
            self.machine.make_automaton()
        self.some = bool(pieces)
        self.single = {p: i for i, p, _ in pieces if len(p) == 1}
        self.cost = min((s for _, _, s in pieces), default=0.0) - UNKNOWN
        self.byte_ids, self.unknown_id, self.prefix = byte_ids, unknown_id, prefix
        self.text = {i: p for i, p, _ in pieces}
        self.junctions: dict[tuple[int, int], bool] = {}
        self.segment = self.stable if merges else self.viterbi
        self.by_word = not any(SPACE in p.lstrip(SPACE) for _, p, _ in pieces)
        self.bytes = {i: p.replace(SPACE, " ").encode() for i, p, _ in pieces} | {i: bytes([b]) for b, i in byte_ids.items()}
        self.memory: dict[str, bytes] = {}
        self.held = 0

    @classmethod
    def from_file(cls, path: str) -> Segmenter:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(m.get_piece_size())
        byte_ids = {int(m.id_to_piece(i)[3:5], 16): i for i in ids if m.is_byte(i)}
        plain = [(i, m.id_to_piece(i), m.get_score(i)) for i in ids if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        trainer = dict(fields(next((v for n, v in fields(m.serialized_model_proto()) if n == 2), b"")))
        kinds = {dict(fields(v)).get(3, 1) for n, v in fields(m.serialized_model_proto()) if n == 1}
        if trainer.get(3, 1) not in (1, 2) or trainer.get(3, 1) == 2 and kinds & {4, 5}:
            raise ValueError(f"{path}: neither of type unigram nor BPE without user-defined and unused pieces")
        return cls(plain, byte_ids, m.unk_id(), merges=trainer.get(3, 1) == 2)

    def junction(self, left: int, right: int) -> bool:
        """Whether the pieces stay side by side under merging; left is -1 where no piece is before."""
        if len(self.junctions) >= MEMORY_JUNCTIONS:
            self.junctions.clear()
        both = [left, right] if left >= 0 else [right]
        fits = self.junctions[left, right] = self.merged("".join(self.text[i] for i in both)) == both
        return fits

    def stable(self, text: str) -> list[int]:
        n, known = len(text), self.junctions
        # The last piece of each prefix, and where it starts; a character without a piece is a piece of its own, -1.
        last, start = [-1] * (n + 1), list(range(-1, n))
        for end, (length, i, _) in self.machine.iter(text) if self.some else ():
            end += 1
            if last[end] < 0:
                left = last[end - length]
                fits = known.get((left, i))
                if fits or fits is None and self.junction(left, i):
                    last[end], start[end] = i, end - length
        out: list[int] = []
        while n:
            if last[n] >= 0:
                out.append(last[n])
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in reversed(text[n - 1].encode())]
            else:
                out.append(self.unknown_id)
            n = start[n]
        return out[::-1]

    def merged(self, text: str) -> list[int]:
        """The plain way, for junctions: of neighbours that make a piece the highest score is merged first, the leftmost of equals."""
        n, found = len(text), {}
        for last, (length, i, score) in self.machine.iter(text) if self.some else ():
            if length > 1:
                found[last + 1 - length, last + 1] = (-score, i)
        # The end of the symbol that starts at a position (0: none starts there), and the start of the one that ends there.
        end, start = list(range(1, n + 1)), list(range(-1, n))
        heap = [(found[a, a + 2][0], a, a + 2) for a in range(n - 1) if (a, a + 2) in found]
        heapq.heapify(heap)
        while heap:
            _, a, c = heapq.heappop(heap)
            b = end[a]
            if not b or b >= c or end[b] != c:
                continue
            end[a], end[b], start[c] = c, 0, a
            if a and (pair := found.get((start[a], c))):
                heapq.heappush(heap, (pair[0], start[a], c))
            if c < n and (pair := found.get((a, end[c]))):
                heapq.heappush(heap, (pair[0], a, end[c]))
        out: list[int] = []
        a = 0
        while a < n:
            c = end[a]
            if c - a > 1:
                out.append(found[a, c][1])
            elif (i := self.single.get(text[a])) is not None:
                out.append(i)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in text[a].encode()]
            else:
                out.append(self.unknown_id)
            a = c
        return out

    def viterbi(self, text: str) -> list[int]:
        n = len(text)
        best, back = [0.0] + [float("-inf")] * n, [(0, -1)] * (n + 1)
        single, cost, done = self.single, self.cost, 0

        def settle(to: int, done: int) -> int:
            while done < to:
                if text[done] not in single and best[done] + cost > best[done + 1]:
                    best[done + 1], back[done + 1] = best[done] + cost, (1, -1)
                done += 1
            return done

        for end, (length, i, score) in self.machine.iter(text) if self.some else ():
            done = settle(end, done)
            score += best[end + 1 - length]
            if score > best[end + 1]:
                best[end + 1], back[end + 1] = score, (length, i)
        settle(n, done)
        out: list[int] = []
        while n:
            length, i = back[n]
            if i >= 0:
                out.append(i)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in reversed(text[n - 1].encode())]
            else:
                out.append(self.unknown_id)
            n -= length
        return out[::-1]

    def marked(self, text: str) -> str:
        return ((SPACE if self.prefix else "") + text.replace(" ", SPACE)) if text else ""

    def packed(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        text = self.marked(text)
        if not self.by_word:
            return np.array(self.segment(text), "<i4").tobytes()
        if self.held > MEMORY_BYTES:
            self.memory.clear()
            self.held = 0
        words = _WORD.findall(text)
        for word in set(words).difference(self.memory):
            self.memory[word] = np.array(self.segment(word), "<i4").tobytes()
            self.held += 2 * len(word) + 200
        return b"".join(map(self.memory.__getitem__, words))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<i4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        known, unknown = self.bytes, " ⁇ ".encode()
        try:
            out = b"".join(map(known.__getitem__, ids))
        except KeyError:
            out = b"".join(known.get(i, unknown if i == self.unknown_id else b"") for i in ids)
        return out[1:] if self.prefix and out[:1] == b" " else out


@lru_cache(maxsize=4)
def segmenter(path: str) -> Segmenter:
    return Segmenter.from_file(path)


def encoded(docs: DataFrame, path: str, text: str = "text", out: str = "piece_ids", back: str | None = None) -> DataFrame:
    """``docs`` with the column ``out`` of ids, array<int>, and with the column ``back`` of the bytes decoded from them."""
    fields = docs.schema.fields
    names = [f"c{i}" for i in range(len(fields))] + ["ids"] + ["back"] * bool(back)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = segmenter(path)
        for batch in batches:
            for first, texts in balanced(batch.column(batch.num_columns - 1)):
                ids = [np.frombuffer(seg.packed(t), "<i4") for t in texts]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                values = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))]
                if back:
                    values.append(pa.array([seg.decode(x.tolist()) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays([*batch.slice(first, len(texts)).columns[:-1], *values], names)

    named = docs.select(*[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(fields)], F.col(text).alias("input"))
    schema = ", ".join([*(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(fields)), "ids array<int>"] + ["back binary"] * bool(back))
    added = [F.col("ids").alias(out)] + ([F.col("back").alias(back)] if back else [])
    return named.mapInArrow(run, schema).select(*[F.col(f"c{i}").alias(f.name) for i, f in enumerate(fields)], *added)


def decoded(docs: DataFrame, path: str, ids: str = "piece_ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the column ``out``: the bytes that the ids stand for; null ids give null."""

    def one(batch: pa.Array) -> pa.Array:
        seg = segmenter(path)
        return pa.array([seg.decode(x.values.to_pylist()) if x.is_valid else None for x in batch], pa.binary())

    return docs.withColumn(out, F.arrow_udf(one, "binary")(F.col(ids)))


def round_trips(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_pieces, ids_crc32, decoded_sha256, same (the decoded bytes are the text's)."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = segmenter(path)
        for batch in batches:
            rows = []
            for _, texts in balanced(batch.column(1)):
                for t in texts:
                    packed, raw = seg.packed(t), t.encode()
                    back = seg.decode(np.frombuffer(packed, "<i4").tolist())
                    rows.append((len(raw), len(packed) // 4, zlib.crc32(packed), hashlib.sha256(back).hexdigest(), back == t.replace(SPACE, " ").encode()))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", "n_bytes", "n_pieces", "ids_crc32", "decoded_sha256", "same"])

    return slim.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_pieces long, ids_crc32 long, decoded_sha256 string, same boolean")
