"""Cutting text into parts, as regular expressions over marks; no position arithmetic, no Python."""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..definition import DefinitionError, Step
from .patterns import CUT, ESCAPE, ONE, TWO, java, literal

BEHAVIOURS = ("match", "remove", "isolate", "merge", "merge_left", "merge_right")


@lru_cache(maxsize=1)
def scripts() -> tuple[str, ...]:
    """All scripts that the JVM's Unicode tables know, but for the common one."""
    known = SparkSession.getActiveSession().sparkContext._jvm.java.lang.Character.UnicodeScript.values()
    return tuple(x for s in known if (x := s.toString()) not in ("COMMON", "UNKNOWN"))


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + TWO)), F.lit(CUT), F.lit(ESCAPE + ONE))


def restored(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE + ONE), F.lit(CUT)), F.lit(ESCAPE + TWO), F.lit(ESCAPE))


def cut(marked: Column) -> Column:
    return F.transform(F.filter(F.split(marked, CUT), lambda x: x != ""), restored)


def pieces(text: Column, pattern: str, behaviour: str) -> Column:
    """The parts of text by a Java pattern: array<string> without empty parts."""
    text = escaped(text)
    if behaviour == "match":
        return F.transform(F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: x != ""), restored)
    if behaviour == "remove":
        return cut(F.regexp_replace(text, pattern, CUT))
    if behaviour == "isolate":
        return cut(F.regexp_replace(text, pattern, f"{CUT}$0{CUT}"))
    if behaviour == "merge":
        joined = F.replace(F.regexp_replace(text, pattern, f"{CUT}$0{ESCAPE}{CUT}"), F.lit(f"{ESCAPE}{CUT}{CUT}"), F.lit(""))
        return cut(F.replace(joined, F.lit(f"{ESCAPE}{CUT}"), F.lit(CUT)))
    if behaviour == "merge_left":
        return cut(F.regexp_replace(text, pattern, f"$0{CUT}"))
    if behaviour == "merge_right":
        return cut(F.regexp_replace(text, pattern, f"{CUT}$0"))
    raise DefinitionError(f"unknown behaviour {behaviour}")


def script_pieces(text: Column) -> Column:
    """Cut where the script changes; common characters stay with the run before them, leading ones with the first run."""
    runs = [f"\\p{{Is{s}}}[\\p{{Is{s}}}\\p{{IsCommon}}]*" for s in scripts()]
    # Characters without a script are one more: what is neither common nor of any of these.
    other = "[^\\p{IsCommon}" + "".join(f"\\p{{Is{s}}}" for s in scripts()) + "]"
    runs.append(f"{other}(?:{other}|\\p{{IsCommon}})*")
    found = F.regexp_extract_all(text, F.lit("(?:\\A\\p{IsCommon}*)?(?:" + "|".join(runs) + ")"), F.lit(0))
    return F.when(text == "", F.array().cast("array<string>")).when(F.size(found) == 0, F.array(text)).otherwise(found)


def split_one(text: Column, s: Step) -> Column:
    if s.name == "scripts":
        return script_pieces(text)
    kind, value = s.args["kind"], s.args["pattern"]
    if kind not in ("char", "string", "regex") or s.name != "split":
        raise DefinitionError(f"unknown split {s}")
    return pieces(text, java(value) if kind == "regex" else literal(value), s.args["behaviour"])


def split(text: Column, steps: tuple[Step, ...]) -> Column:
    """The parts after all splits, each cutting every part of the one before; no split: the text is one part."""
    whole = F.filter(F.array(text), lambda x: x != "")
    return reduce(lambda parts, s: F.flatten(F.transform(parts, lambda x: split_one(x, s))), steps, whole)
