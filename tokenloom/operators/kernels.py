"""The subword models on one part of text: text in, ids out.  Run inside Arrow batches, with a bounded memory of parts."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..definition import Definition

MEMORY_PARTS = 200_000
LINEAR_UNITS = 96


class EncodeError(ValueError):
    pass


class Encoder:
    """Common to the models: vocabulary, fallback, the memory of parts."""

    def __init__(self, d: Definition):
        self.d = d
        self.unknown = d.unknown_id()
        self.memory: dict[str, list[int]] = {}
        ids = {b: i for i, b in reversed(d.vocab)} if d.model != "wordpiece" else {b: i for i, b in d.vocab}
        self.ids = ids
        self.least, self.most = min(map(len, ids)), max(map(len, ids))
        make = {"bytepair": self._bytepair, "unigram": self._unigram, "wordpiece": self._wordpiece}[d.model]
        self.part: Callable[[str], list[int]] = make()

    def __call__(self, text: str) -> list[int]:
        known = self.memory.get(text)
        if known is None:
            known = self.part(text)
            if len(text) <= 64:
                if len(self.memory) >= MEMORY_PARTS:
                    self.memory.clear()
                self.memory[text] = known
        return known

    def _missing(self, unit: bytes, fallback: tuple[str, ...], again: Callable[[bytes, tuple[str, ...]], list[int]] | None) -> list[int]:
        """Only the head of the list counts; bytes hands the rest of the list on."""
        head = fallback[0] if fallback else ""
        if head == "bytes" and again:
            return [x for b in unit for x in again(bytes([b]), fallback[1:])]
        if head == "unknown" and self.unknown is not None:
            return [self.unknown]
        if head == "skip":
            return []
        raise EncodeError(f"no token for {unit!r}")

    # Byte pairs: any two neighbours whose join is in the vocabulary may merge, the lowest rank first, the leftmost of equals.

    def _bytepair(self) -> Callable[[str], list[int]]:
        rank = {b: r for r, (_, b) in reversed(list(enumerate(self.d.vocab)))}
        suffix, chars = self.d.word_end.encode(), self.d.chars

        def lookup(unit: bytes, fallback: tuple[str, ...]) -> list[int]:
            if unit in self.ids:
                return [self.ids[unit]]
            return self._missing(unit, fallback, lookup)

        def part(text: str) -> list[int]:
            raw = text.encode()
            whole = raw + suffix
            if self.least <= len(whole) <= self.most and whole in self.ids:
                return [self.ids[whole]]
            units = [c.encode() for c in text] if chars else [raw[i : i + 1] for i in range(len(raw))]
            if not units:
                return []
            units[-1] += suffix
            units = merge_short(units, rank) if len(units) <= LINEAR_UNITS else merge_long(units, rank)
            out: list[int] = []
            for k, unit in enumerate(units):
                if unit in self.ids:
                    out.append(self.ids[unit])
                    continue
                last = k == len(units) - 1 and suffix
                bare = unit[: len(unit) - len(suffix)] if last and self.d.fallback[:1] == ("bytes",) else unit
                out += self._missing(bare, self.d.fallback, lookup)
            return out

        return part

    # Unigram: the cheapest segmentation into scored tokens; a unit without any costs LOST and falls back.

    LOST = 1_000_000.0

    def _unigram(self) -> Callable[[str], list[int]]:
        score = {b: float(np.float32(s)) for (_, b), s in zip(self.d.vocab, self.d.scores, strict=True)}

        def segment(units: list[bytes], fallback: tuple[str, ...]) -> list[int]:
            n = len(units)
            cost, back = [0.0] + [self.LOST] * n, [0] * (n + 1)
            for e in range(1, n + 1):
                found, token = None, b""
                # From the nearest start on: of equal costs the longer token wins.
                for s in range(e - 1, -1, -1):
                    token = units[s] + token
                    if len(token) > self.most:
                        break
                    if token in score:
                        c = cost[s] - score[token]
                        if found is None or c <= found:
                            found, back[e] = c, s + 1
                if found is not None:
                    cost[e] = found
            out: list[int] = []
            e = n
            while e:
                if back[e]:
                    s = back[e] - 1
                    out.append(self.ids[b"".join(units[s:e])])
                else:
                    s = e - 1
                    again = (lambda u, f: segment([u], f)) if len(units[s]) > 1 or fallback[:1] == ("bytes",) else None
                    out += reversed(self._missing(units[s], fallback, again))
                e = s
            return out[::-1]

        return lambda text: segment([c.encode() for c in text], self.d.fallback)

    # Word pieces: the longest start, then the longest continuations; a dead end drops the word.

    def _wordpiece(self) -> Callable[[str], list[int]]:
        mark = self.d.word_continuation.encode()
        starts: dict[bytes, int] = {}
        more: dict[bytes, int] = {}
        for i, b in self.d.vocab:
            if mark and b.startswith(mark):
                more[b[len(mark) :]] = i
            else:
                starts[b] = i
        most = max(map(len, [*starts, *more]))

        def part(text: str) -> list[int]:
            raw = text.encode()
            if len(raw) < self.least or self.d.max_word_chars and len(text) > self.d.max_word_chars:
                return self._missing(raw, self.d.fallback, None)
            out: list[int] = []
            at, table = 0, starts
            while at < len(raw):
                end = next((e for e in range(min(len(raw), at + most), at, -1) if raw[at:e] in table), 0)
                if not end:
                    return self._missing(raw, self.d.fallback, None)
                out.append(table[raw[at:end]])
                at, table = end, more
            return out

        return part


def merge_short(units: list[bytes], rank: dict[bytes, int]) -> list[bytes]:
    units = list(units)
    while len(units) > 1:
        best = min(((rank[t], i) for i in range(len(units) - 1) if (t := units[i] + units[i + 1]) in rank), default=None)
        if best is None:
            break
        units[best[1] : best[1] + 2] = [units[best[1]] + units[best[1] + 1]]
    return units


def merge_long(units: list[bytes], rank: dict[bytes, int]) -> list[bytes]:
    """The same order with a heap; a pair that has changed since it was pushed is passed over."""
    text: list[bytes | None] = list(units)
    after, before = list(range(1, len(units) + 1)), list(range(-1, len(units) - 1))
    heap: list[tuple[int, int, bytes]] = []

    def push(i: int) -> None:
        j = after[i]
        if j < len(text) and (t := text[i] + text[j]) in rank:
            heapq.heappush(heap, (rank[t], i, t))

    for i in range(len(units) - 1):
        push(i)
    while heap:
        _, i, t = heapq.heappop(heap)
        j = after[i]
        if text[i] is None or j >= len(text) or text[i] + text[j] != t:
            continue
        text[i], text[j] = t, None
        after[i] = after[j]
        if after[i] < len(text):
            before[after[i]] = i
        if before[i] >= 0:
            push(before[i])
        push(i)
    return [x for x in text if x is not None]


def gathered(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[start : start + length] of all, one after the other."""
    before = np.cumsum(lengths) - lengths
    return values[np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))]


def row_bounds(rows: pa.ListArray) -> np.ndarray:
    """Where each row's items begin among those of all rows that aren't null; one entry more than rows."""
    sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def lists(rows: pa.ListArray, ends: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=rows.is_null() if rows.null_count else None)


def encoded_parts(encode: Encoder, rows: pa.ListArray) -> pa.ListArray:
    """ids of rows of parts (text, special): each distinct text of the batch is encoded once."""
    flat, bounds = rows.flatten(), row_bounds(rows)
    special, coded = flat.field("special"), flat.field("text").dictionary_encode()
    marks = special.dictionary_encode()
    ids = [encode(text) for text in coded.dictionary.to_pylist() if text is not None]
    ids += [[i] for i in marks.dictionary.to_pylist()]
    lengths = np.array([len(x) for x in ids], np.int64)
    values = np.fromiter((i for x in ids for i in x), np.int64, int(lengths.sum()))
    code = pc.fill_null(coded.indices, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    mark = pc.fill_null(marks.indices, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    code = np.where(special.is_valid().to_numpy(zero_copy_only=False), len(coded.dictionary) + mark, code)
    if not len(ids):
        return lists(rows, bounds, pa.array([], pa.int64()))
    sizes = lengths[code]
    ends = np.concatenate([[0], np.cumsum(sizes)])[bounds]
    return lists(rows, ends, pa.array(gathered(values, (np.cumsum(lengths) - lengths)[code], sizes)))


class Decoder:
    """ids to bytes; the vocabulary comes before special tokens, and those come out only if their kind is asked for.

    A token has two forms: one where nothing has come out of the row yet, and one after that; they differ for word pieces.
    """

    def __init__(self, d: Definition, kinds: set[str]):
        mark = d.word_continuation.encode()
        gap = b" " if mark else b""
        forms = {s.id: (x := s.bytes if s.kind in kinds else b"", gap + x) for s in d.specials}
        for i, b in reversed(d.vocab):
            inner = bool(mark) and b.startswith(mark)
            forms[i] = (b[len(mark) :], b[len(mark) :]) if inner else (b, gap + b)
        self.ids = np.array(sorted(forms), np.int64)
        both = [forms[i][k] for k in (0, 1) for i in self.ids.tolist()]
        self.table = pa.array(both, pa.large_binary())
        self.some = np.array([len(x) > 0 for x in both[: len(self.ids)]])

    def rows(self, rows: pa.ListArray) -> pa.Array:
        flat, bounds = rows.flatten().to_numpy(zero_copy_only=False), row_bounds(rows)
        at = np.minimum(np.searchsorted(self.ids, flat), len(self.ids) - 1)
        lost = self.ids[at] != flat
        if lost.any():
            raise EncodeError(f"no token has the id {flat[lost][0]}")
        shown = self.some[at]
        before = np.cumsum(shown) - shown
        count = np.diff(bounds)
        first = before == np.repeat(before[np.minimum(bounds[:-1], max(0, len(before) - 1))], count) if len(flat) else before
        out = self.table.take(pa.array(np.where(first, at, at + len(self.ids))))
        _, offsets, data = out.buffers()
        offsets = np.frombuffer(offsets, np.int64)[out.offset : out.offset + len(out) + 1] if len(flat) else np.zeros(1, np.int64)
        ends = offsets[bounds]
        valid = pc.is_valid(rows).buffers()[1] if rows.null_count else None
        made = pa.Array.from_buffers(pa.large_binary(), len(rows), [valid, pa.py_buffer(np.ascontiguousarray(ends)), data if data is not None else pa.py_buffer(b"")])
        return made.cast(pa.binary())

    def __call__(self, ids: list[int]) -> bytes:
        return self.rows(pa.array([ids], pa.list_(pa.int64())))[0].as_py()
