"""Steps on ids, and on decoded text, as array and string expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..definition import DefinitionError, Step
from .normalize import COLUMN


def strip(a: Column, id: int, left: int = 0, right: int = 0) -> Column:
    other = F.nullif(F.array_position(F.transform(a, lambda x: x != id), True), F.lit(0))
    lead = F.coalesce(other - 1, F.size(a))
    a = F.slice(a, F.least(lead, F.lit(left)) + 1, F.size(a))
    other = F.nullif(F.array_position(F.transform(F.reverse(a), lambda x: x != id), True), F.lit(0))
    return F.slice(a, F.lit(1), F.size(a) - F.least(F.coalesce(other - 1, F.size(a)), F.lit(right)))


def collapse(a: Column, id: int) -> Column:
    return F.filter(a, lambda x, i: (x != id) | (i == 0) | (F.get(a, i - 1) != id))


def rounded(n: Column, stride: int) -> Column:
    return (F.ceil(n / max(1, stride)) * max(1, stride)).cast("int")


def pad(a: Column, id: int, length: int, stride: int = 1, left: bool = False) -> Column:
    more = F.array_repeat(F.lit(id).cast("long"), rounded(F.greatest(F.lit(length) - F.size(a), F.lit(0)), stride))
    return F.concat(more, a) if left else F.concat(a, more)


def truncate(a: Column, length: int, stride: int = 1, left: bool = False) -> Column:
    """Drops len - length ids, rounded up to a multiple of stride, and never more than there are."""
    drop = F.least(F.size(a), rounded(F.greatest(F.size(a) - length, F.lit(0)), stride))
    return F.slice(a, drop + 1, F.size(a)) if left else F.slice(a, F.lit(1), F.size(a) - drop)


STEPS = {"strip": strip, "collapse": collapse, "pad": pad, "truncate": truncate}


def process(ids: Column, steps: tuple[Step, ...]) -> Column:
    def one(a: Column, s: Step) -> Column:
        if s.name not in STEPS:
            raise DefinitionError(f"unknown processing {s.name}")
        return F.when(F.size(a) > 0, STEPS[s.name](a, **s.args)).otherwise(a)

    return reduce(one, steps, ids)


def replaced_bytes(old: bytes, new: bytes) -> Callable[[Column], Column]:
    """Literal replacement that leaves bytes which aren't text alone; an Arrow kernel, without a Python object for a row."""

    def run(batch: pa.Array) -> pa.Array:
        return pc.replace_substring(batch, old, new) if old else batch

    return F.arrow_udf(run, "binary")


def finish(raw: Column, steps: tuple[Step, ...]) -> Column:
    """Decoding steps on bytes.  Literal replacement works on bytes; other steps see text, in which bytes that aren't become U+FFFD."""
    for s in steps:
        if s.name == "replace":
            raw = replaced_bytes(s.args["old"].encode(), s.args["new"].encode())(raw)
            continue
        if s.name not in ("extend", "strip", "collapse", "replace_regex"):
            raise DefinitionError(f"unknown decoding {s.name}")
        text = F.make_valid_utf8(raw.cast("string"))
        raw = F.when(text != "", COLUMN[s.name](text, **s.args)).otherwise(text).cast("binary")
    return raw


def text_of(ids: Column) -> Column:
    """Ids as text, with a space after each but the last."""
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), " ")


def ids_of(text: Column) -> Column:
    """Ids from text that separates them by spaces, commas or line ends; anything that isn't a number fails."""
    return F.transform(F.filter(F.split(text, "[ ,\n]"), lambda x: x != ""), lambda x: x.cast("long"))
