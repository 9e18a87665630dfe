"""Normalization steps as Column expressions; Unicode forms and character maps are the two Arrow kernels.

A step maps an array<string> column of segments, so that segments cut at special tokens stay in their row.
"""

from __future__ import annotations

import struct
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..definition import DefinitionError, Step
from .patterns import java, literal, plain_replacement, replacement

ALL = (1 << 32) - 1
#: Control characters that the NMT rule deletes, and characters it turns into spaces.
NMT_GONE = [*range(0x01, 0x09), 0x0B, *range(0x0E, 0x20), 0x7F, 0x8F, 0x9F]
NMT_SPACE = [0x00, 0x0A, 0x0C, 0x0D, 0x1680, *range(0x200B, 0x2010), 0x2028, 0x2029, 0x2581, 0xFEFF, 0xFFFD]


def _class(points: list[int]) -> str:
    return "[" + "".join(f"\\x{{{p:x}}}" for p in points) + "]"


def _many(n: int) -> str:
    return "*" if n >= ALL else f"{{0,{n}}}"


def strip(c: Column, ch: str, left: int, right: int) -> Column:
    c = F.regexp_replace(c, f"\\A(?:{literal(ch)}){_many(left)}", "") if left else c
    return F.regexp_replace(c, f"(?<!{literal(ch)})(?:{literal(ch)})+\\z", "") if right >= ALL else _strip_right(c, ch, right)


def _strip_right(c: Column, ch: str, right: int) -> Column:
    for _ in range(right):
        c = F.regexp_replace(c, f"{literal(ch)}\\z", "")
    return c


def extend(c: Column, ch: str, left: int, right: int, pad: bool) -> Column:
    have_left = F.length(F.regexp_extract(c, f"\\A(?:{literal(ch)}){{0,{left}}}", 0)) if pad else F.lit(0)
    have_right = F.length(F.regexp_extract(c, f"(?:{literal(ch)}){{1,{max(1, right)}}}\\z", 0)) if pad and right else F.lit(0)
    return F.concat(F.repeat(F.lit(ch), F.lit(left) - have_left), c, F.repeat(F.lit(ch), F.lit(right) - have_right))


#: Steps that are a function of one text column.
COLUMN: dict[str, Callable[..., Column]] = {
    "nmt": lambda c: F.regexp_replace(F.regexp_replace(c, _class(NMT_GONE), ""), _class(NMT_SPACE), " "),
    "casefold": lambda c, upper=False: F.upper(c) if upper else F.lower(c),
    "append": lambda c, text: F.concat(c, F.lit(text)),
    "prepend": lambda c, text: F.concat(F.lit(text), c),
    "extend": lambda c, ch, left=0, right=0, pad=False: extend(c, ch, left, right, pad),
    "strip": lambda c, ch, left=0, right=0: strip(c, ch, left, right),
    "collapse": lambda c, ch: F.regexp_replace(c, f"(?:{literal(ch)})+", plain_replacement(ch)),
    "replace": lambda c, old, new: F.replace(c, F.lit(old), F.lit(new)),
    "replace_regex": lambda c, pattern, new: F.regexp_replace(c, java(pattern), replacement(new)),
}


class CharsMap:
    """A double-array trie from text to text: size in bytes, units, then a pool of NUL-ended strings."""

    def __init__(self, blob: bytes):
        (size,) = struct.unpack_from("<I", blob)
        if size % 4 or 4 + size > len(blob):
            raise DefinitionError("the character map is cut short")
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
        self.pool = blob[4 + size :]

    def shortest(self, key: bytes) -> tuple[int, int] | None:
        """Bytes taken and pool offset of the shortest prefix of key that the map knows."""
        offset = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
        node = offset(self.units[0]) if self.units else 0
        for i, byte in enumerate(key):
            node ^= byte
            if node >= len(self.units) or self.units[node] & 0x800000FF != byte:
                return None
            unit = self.units[node]
            node ^= offset(unit)
            if unit >> 8 & 1:
                return i + 1, self.units[node] & 0x7FFFFFFF
        return None

    def target(self, at: int) -> str:
        return self.pool[at : self.pool.index(b"\0", at)].decode()

    def apply(self, text: str) -> str:
        import regex

        out = []
        for grapheme in regex.findall(r"\X", text):
            raw = grapheme.encode()
            hit = self.shortest(raw) if len(raw) < 6 else None
            if hit:
                out.append(self.target(hit[1]))
                continue
            for ch in grapheme:
                hit = self.shortest(ch.encode())
                out.append(self.target(hit[1]) if hit else ch)
        return "".join(out)


def charsmap_blob(pairs: dict[str, str]) -> bytes:
    """The double-array trie for a map of texts: every node of the trie has a block of 256 units of its own."""
    nodes: list[dict[int, int]] = [{}]
    leaves: dict[int, int] = {}
    pool = b""
    for key, value in pairs.items():
        at = 0
        for byte in key.encode():
            if byte not in nodes[at]:
                nodes[at][byte] = len(nodes)
                nodes.append({})
            at = nodes[at][byte]
        leaves[at] = len(pool)
        pool += value.encode() + b"\0"
    base = lambda node: 256 * (node + 1)
    units = [0] * base(len(nodes))
    units[0] = base(0) << 10
    for node, children in enumerate(nodes):
        for byte, child in children.items():
            place = base(node) ^ byte
            units[place] = (place ^ base(child)) << 10 | (child in leaves) << 8 | byte
        if node in leaves:
            units[base(node)] = 1 << 31 | leaves[node]
    return struct.pack(f"<I{len(units)}I", 4 * len(units), *units) + pool


def _arrow(of: Callable[[str], str]) -> Callable[[Column], Column]:
    def run(batch: pa.Array) -> pa.Array:
        # Once for each distinct segment; most texts are one segment.
        flat = batch.flatten().dictionary_encode()
        made = pa.array([None if x is None else of(x) for x in flat.dictionary.to_pylist()], pa.string()).take(flat.indices)
        sizes = pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False)
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        return pa.ListArray.from_arrays(ends, made, mask=batch.is_null() if batch.null_count else None)

    return F.arrow_udf(run, "array<string>")


def normalized(segments: Column, steps: tuple[Step, ...]) -> Column:
    """Each segment after all steps; empty segments and null ones (special tokens) stay as they are."""
    for s in steps:
        if s.name == "unicode":
            form = s.args["form"].upper()
            if form not in ("NFC", "NFD", "NFKC", "NFKD"):
                raise DefinitionError(f"unknown Unicode form {form}")
            segments = _arrow(lambda x, form=form: unicodedata.normalize(form, x))(segments)
        elif s.name == "charsmap":
            segments = _arrow(CharsMap(bytes.fromhex(s.args["blob"])).apply)(segments)
        else:
            segments = F.transform(segments, _guarded(s, F.size(segments)))
    return segments


def _guarded(s: Step, n: Column) -> Callable[[Column, Column], Column]:
    def one(x: Column, i: Column) -> Column:
        if s.name == "conditional":
            inner = Step(s.args["step"]["name"], s.args["step"]["args"])
            there = i == 0 if s.args["position"] == "start" else i == n - 1
            return F.when(there & (x != ""), _apply(inner, x)).otherwise(x)
        return F.when(x != "", _apply(s, x)).otherwise(x)

    return one


def _apply(s: Step, c: Column) -> Column:
    if s.name not in COLUMN:
        raise DefinitionError(f"unknown normalization {s.name}")
    return COLUMN[s.name](c, **s.args)


def normalize(text: Column, steps: tuple[Step, ...]) -> Column:
    """One text column after all steps."""
    return F.get(normalized(F.array(text), steps), 0)
