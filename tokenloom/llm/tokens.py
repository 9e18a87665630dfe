"""Token counts and token-id files.

Counts and ids come from the library that belongs to the vocabulary file, for batches of about BATCH_BYTES of UTF-8.  Texts are cut
at boundaries that its pre-tokenizer can't cross (before a white-space run or before the single space that joins a word), and the
library's result for each piece is kept in a bounded memory of the worker, since most pieces recur.  Where rare white space,
control characters or strings of added tokens make these cuts unproven, a text is first cut about every CUT_CHARS characters
between a letter or digit and a space that a letter follows, which is a boundary whatever else the text holds, and only the parts
with such characters go to the library as they are.  With other pre-tokenizers, normalizers, or added tokens that take spaces, texts
go to the library whole.

Nulls: a null text counts as empty and has 0 tokens.  Every input row gives one row, repeated ones too; ids may be of any type, and a
null id is kept and sorts first.  Other columns are not read, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.formats import byte_alphabet
from .common import Scratch

BATCH_BYTES = 1 << 20
CUT_CHARS = 1 << 12
MEMORY_BYTES = 192 << 20
#: A run of common letters ends before white space and before ASCII punctuation other than an apostrophe; other pieces run to the
#: next white space.
_LETTERS = "[ ]?[A-Za-zÀ-ÖØ-öø-ÿ]+"
_PIECE = re.compile(_LETTERS + r"(?=[ \t\n\r!-&(-/:-@\[-`{-~]|\Z)|[ ]?[^ \t\n\r]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+")
_WORD = re.compile(_LETTERS)
#: White space and format characters on which regex engines differ.
_ODD = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff]")


#: A letter or digit before a space and a letter: the space starts a token of its own in byte-level pre-tokenizing.
_SAFE = re.compile("(?<=[A-Za-z0-9])(?= [A-Za-z])")


class Library:
    """Ids of whole texts by the library for a vocabulary file: .json or .model."""

    def __init__(self, path: str):
        self.pieces = self.cuttable = False
        self.added: list[str] = []
        if path.endswith(".json"):
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            self.encode = lambda texts: [x.ids for x in tok.encode_batch_fast(texts, add_special_tokens=False)]
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            self.added = [x["content"] for x in spec.get("added_tokens") or []]
            pre = spec.get("pre_tokenizer") or {}
            self.pieces = not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True) and spec["model"].get("type") == "BPE" and not spec["model"].get("dropout")
            self.size = tok.get_vocab_size()
            # The pre-tokenizer leaves a run of letters whole, so the library's model can take it without the steps before.
            split = tok.model.tokenize
            alphabet = {b: c for c, b in byte_alphabet().items()}
            self.cuttable = self.pieces and not any(x.get("lstrip") or x.get("rstrip") or " " in x["content"] for x in spec.get("added_tokens") or [])
            self.word = lambda piece: [t.id for t in split(piece.encode().decode("latin-1").translate(alphabet))]
        elif path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: model.encode(texts, num_threads=1)
            self.size = model.get_piece_size()
        else:
            raise ValueError(f"no library is known for {path}")
        self.type = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.memory: dict[str, bytes] = {}
        self.held = 0

    def _whole(self, text: str) -> bool:
        return not self.pieces or _ODD.search(text) is not None or any(x in text for x in self.added)

    def packed(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as bytes of self.type."""
        parts = [self.parts(t) if self.cuttable and len(t) > CUT_CHARS and self._whole(t) else [t] for t in texts]
        done = iter(self._packed([x for p in parts for x in p]))
        return [b"".join(next(done) for _ in p) for p in parts]

    def parts(self, text: str) -> list[str]:
        out, at = [], 0
        while at < len(text):
            cut = _SAFE.search(text, at + CUT_CHARS)
            end = cut.start() if cut else len(text)
            out.append(text[at:end])
            at = end
        return out

    def _packed(self, texts: list[str]) -> list[bytes]:
        out: list = [b""] * len(texts)
        direct, cut, wanted = [], [], set()
        for i, text in enumerate(texts):
            if not text:
                continue
            if self._whole(text):
                direct.append(i)
            else:
                pieces = _PIECE.findall(text)
                cut.append((i, pieces))
                wanted.update(pieces)
        if direct:
            for i, ids in zip(direct, self.encode([texts[i] for i in direct]), strict=True):
                out[i] = np.array(ids, self.type).tobytes()
        missing = list(wanted.difference(self.memory))
        if missing:
            if self.held > MEMORY_BYTES:
                self.memory.clear()
                self.held = 0
                missing = list(wanted)
            code = "H" if self.type.itemsize == 2 else "I"
            plain, others = [], []
            for piece in missing:
                (plain if _WORD.fullmatch(piece) else others).append(piece)
            found = zip(others, self.encode(others), strict=True) if others else ()
            for piece, ids in chain(found, zip(plain, map(self.word, plain), strict=True)):
                self.memory[piece] = array(code, ids).tobytes()
                self.held += 2 * len(piece) + 160
        known = self.memory.__getitem__
        for i, pieces in cut:
            out[i] = b"".join(map(known, pieces))
        return out

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(x) // self.type.itemsize for x in self.packed(texts)]


@lru_cache(maxsize=4)
def library(path: str) -> Library:
    return Library(path)


def balanced(column: pa.Array, limit: int = BATCH_BYTES) -> Iterator[tuple[int, list[str]]]:
    """Successive rows, as (index of the first, texts), with about ``limit`` bytes of UTF-8 together; nulls are empty."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(ends):
        before = ends[first - 1] if first else 0
        stop = max(first + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield first, [x or "" for x in column.slice(first, stop - first).to_pylist()]
        first = stop


def token_counts(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = library(path)
        for batch in batches:
            lengths: list[int] = []
            for _, texts in balanced(batch.column(2)):
                lengths += lib.lengths(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lengths, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    slim = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


# Token-id files ------------------------------------------------------------------------------------------------------------

#: Chunk layout, little-endian: MAGIC, counts (documents, ids, ids in a block, planes, bytes of the compressed lengths), the lengths of
#: documents, the compressed length of each plane of each block, the planes.  Document ids are a column beside the chunk, of their type.
MAGIC = b"TLPLANE2"
_HEAD = struct.Struct("<QQQQQ")
BLOCK = 1 << 16
CHUNK_IDS = 1 << 20


def planes(ids: np.ndarray, bits: bool) -> np.ndarray:
    """One row for each byte (or bit) of the ids, least significant byte first."""
    rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    return np.packbits(np.unpackbits(rows, axis=1).T, axis=1) if bits else np.ascontiguousarray(rows.T)


def unplanes(rows: np.ndarray, n: int, bits: bool) -> np.ndarray:
    if bits:
        rows = np.packbits(np.unpackbits(rows, axis=1, count=n).T, axis=1).T
    return np.ascontiguousarray(rows.T).reshape(-1).view("<u4")


def pack_chunk(ids: np.ndarray, lengths: list[int], bits: bool = False, block: int = BLOCK) -> bytes:
    import zstandard

    press = zstandard.ZstdCompressor(level=3).compress
    parts = [press(plane.tobytes()) for at in range(0, len(ids), block) for plane in planes(ids[at : at + block], bits)]
    table = press(np.array(lengths, "<u8").tobytes())
    head = _HEAD.pack(len(lengths), len(ids), block, 32 if bits else 4, len(table))
    return b"".join([MAGIC, head, table, np.array([len(x) for x in parts], "<u4").tobytes(), *parts])


def unpack_chunk(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """ids, lengths."""
    import zstandard

    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token-id chunk")
    open_ = zstandard.ZstdDecompressor().decompress
    n_docs, n_ids, block, n_planes, table_size = _HEAD.unpack_from(data, len(MAGIC))
    at = len(MAGIC) + _HEAD.size
    lengths = np.frombuffer(open_(data[at : at + table_size]), "<u8", n_docs).astype(np.int64)
    at += table_size
    sizes = np.frombuffer(data, "<u4", -(-n_ids // block) * n_planes, at)
    at += sizes.nbytes
    out = []
    for b in range(0, len(sizes), n_planes):
        rows = []
        for size in sizes[b : b + n_planes]:
            rows.append(np.frombuffer(open_(data[at : at + size]), np.uint8))
            at += int(size)
        out.append(unplanes(np.stack(rows), min(block, n_ids - b // n_planes * block), n_planes == 32))
    return (np.concatenate(out) if out else np.zeros(0, "<u4")), lengths


def write_ids(docs: DataFrame, path: str, vocabulary: str, text: str = "text", doc_id: str = "doc_id", end_id: int = 0, bits: bool = False) -> None:
    """Writes the ids of all documents, in ascending order of doc_id, as chunks of whole documents under ``path``.

    Rows are range-partitioned on (doc_id, hash of the text); each partition is a shard and is written in order by Spark's own
    committer, so a lost or repeated task leaves no partial files.  The chunk index is in the columns beside each chunk.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lib, shard, chunk, start = library(vocabulary), TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], "<u4")
        ids, doc_ids, lengths, held, key_type = [], [], [], 0, []

        def flush() -> pa.RecordBatch:
            values = [shard, chunk, start, held, doc_ids, pack_chunk(np.concatenate(ids), lengths, bits)]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(key_type[0]), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, types, strict=True)], ["shard", "chunk", "start", "n_ids", "doc_ids", "data"])

        for batch in batches:
            keys, key_type[:] = batch.column(0).to_pylist(), [batch.column(0).type]
            for first, texts in balanced(batch.column(1)):
                for i, packed in enumerate(lib.packed(texts), first):
                    ids += [np.frombuffer(packed, lib.type).astype("<u4"), end]
                    doc_ids.append(keys[i])
                    lengths.append(len(ids[-2]) + 1)
                    held += lengths[-1]
                    if held >= CHUNK_IDS:
                        yield flush()
                        chunk, start = chunk + 1, start + held
                        ids, doc_ids, lengths, held = [], [], [], 0
        if doc_ids:
            yield flush()

    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    placed = slim.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    placed.mapInArrow(encode, f"shard int, chunk long, start long, n_ids long, doc_ids array<{kind}>, data binary").write.option("compression", "none").parquet(path)


def read_ids(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the documents written under ``path``; chunks are decoded where they are read."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard, start, data = (batch.column(i)[row].as_py() for i in (0, 1, 3))
                ids, lengths = unpack_chunk(data)
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends, lengths, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * len(lengths), pa.int32()), batch.column(2)[row].values, pa.array(start + ends - lengths), pa.array(lengths), pa.array(crcs, pa.int64())],
                    ["shard", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    files = spark.read.parquet(path)
    # One row for each shard, that is for each partition of the writer: small whatever the corpus holds.
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("before"))
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    decoded = files.select("shard", "start", "doc_ids", "data").mapInArrow(decode, f"shard int, doc_id {kind}, at long, n_tokens long, ids_crc32 long")
    return decoded.join(F.broadcast(offsets), "shard").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def id_digests(docs: DataFrame, vocabulary: str, text: str = "text", doc_id: str = "doc_id", end_id: int = 0, bits: bool = False) -> DataFrame:
    path = Scratch(docs.sparkSession, "token-ids").path("ids")
    write_ids(docs, path, vocabulary, text, doc_id, end_id, bits)
    return read_ids(docs.sparkSession, path)
