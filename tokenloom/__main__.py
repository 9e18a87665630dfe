"""python -m tokenloom convert | compare | inspect | encode | decode.

encode and decode take a file, a literal, or with --column a Parquet table of any size, which is written to --out.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .definition import Definition, DefinitionError
from .functions.process import ids_of, text_of
from .operators.tokenizer import Tokenizer
from .sources.formats import from_bytes, to_bytes

SUFFIX = ".tldef"


def read(path: str) -> Definition:
    with open(path, "rb") as f:
        return from_bytes(f.read())


def convert(path: str) -> list[str]:
    """Writes each definition next to its source; a folder stands for the files in it."""
    found = [os.path.join(path, x) for x in sorted(os.listdir(path))] if os.path.isdir(path) else [path]
    made = []
    for name in found:
        if os.path.isfile(name) and not name.endswith(SUFFIX):
            with open(name + SUFFIX, "wb") as f:
                f.write(to_bytes(read(name)))
            made.append(name + SUFFIX)
    return made


def differences(one: Definition, two: Definition) -> list[str]:
    """What differs, with the number of positions at which both have an entry and these are unequal."""
    if one == two:
        return []
    out = ["definitions differ"]
    for what, a, b in (("vocabularies", one.exported(), two.exported()), ("special tokens", one.ordered_specials(), two.ordered_specials())):
        if a != b:
            out.append(f"{what} differ: {sum(x != y for x, y in zip(a, b, strict=False))} entries, of {len(a)} and {len(b)}")
    if replace(one, vocab=(), scores=(), specials=()) != replace(two, vocab=(), scores=(), specials=()):
        out.append("configurations differ")
    return out


def inspected(d: Definition) -> str:
    body = json.loads(d.to_json())
    body["vocab"] = f"{len(d.vocab)} tokens"
    body["scores"] = f"{len(d.scores)} scores"
    body["specials"] = [{"id": s.id, "token": s.bytes.decode(), "kind": s.kind, "extract": s.extract} for s in d.ordered_specials()]
    return json.dumps(body, ensure_ascii=False, indent=1)


def content(given: str) -> str:
    if os.path.isfile(given):
        with open(given, encoding="utf-8", newline="") as f:
            return f.read()
    print(f"no file {given!r}, taken as the text itself", file=sys.stderr)
    return given


def encoded(tok: Tokenizer, df: DataFrame, column: str) -> DataFrame:
    return tok.encode(df, column, "tokens").withColumn("tokens", text_of(F.col("tokens")))


def decoded(tok: Tokenizer, df: DataFrame, column: str) -> DataFrame:
    """column: arrays of ids, or ids as text."""
    if df.schema[column].dataType.simpleString() == "string":
        df = df.withColumn(column, ids_of(F.col(column)))
    return tok.decode(df, column, "bytes")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tokenloom")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("convert", help="write a tokenizer file as a definition").add_argument("path")
    sub.add_parser("inspect", help="show a tokenizer file").add_argument("path")
    c = sub.add_parser("compare", help="compare two tokenizer files")
    c.add_argument("one")
    c.add_argument("two")
    for name in ("encode", "decode"):
        c = sub.add_parser(name, help=f"{name} a file, a literal or a column of a table")
        c.add_argument("model")
        c.add_argument("input")
        c.add_argument("--column", help="the input is a Parquet table with this column")
        c.add_argument("--out", help="where the table with the results is written")
    a = p.parse_args(argv)
    try:
        if a.command == "convert":
            if not os.path.exists(a.path):
                raise DefinitionError(f"no file or folder {a.path}")
            print(*convert(a.path), sep="\n")
        elif a.command == "compare":
            found = differences(read(a.one), read(a.two))
            print(*(found or ["definitions are the same"]), sep="\n")
            return 1 if found else 0
        elif a.command == "inspect":
            print(inspected(read(a.path)))
        else:
            if bool(a.column) != bool(a.out):
                raise DefinitionError("--column and --out go together")
            tok, spark = Tokenizer(read(a.model)), SparkSession.builder.appName("tokenloom").getOrCreate()
            if a.column:
                df = spark.read.parquet(a.input)
                (tok.encode(df, a.column, "tokens") if a.command == "encode" else decoded(tok, df, a.column)).write.parquet(a.out)
            else:
                one = spark.createDataFrame([(content(a.input),)], "x string")
                print(encoded(tok, one, "x").first()["tokens"] if a.command == "encode" else bytes(decoded(tok, one, "x").first()["bytes"]).decode())
    except (DefinitionError, OSError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
