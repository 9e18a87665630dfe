"""Encoding and decoding as DataFrame plans.

Cutting, normalizing and splitting are Column expressions on arrays within the row; one Arrow call turns a row's parts into ids.
Nothing shuffles, so the same plan runs on streams.  Within an Arrow batch the model runs once for each distinct part, and ids are
gathered by offsets, without a Python object for a part.  ``encode_distinct`` and ``piece_counts`` go by distinct parts of the whole
table instead: a partial aggregate brings them together and the model runs once for each.
"""

from __future__ import annotations

import json
import pickle
from dataclasses import replace
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..definition import Definition, Special
from ..functions.normalize import normalized
from ..functions.patterns import CUT, ESCAPE, literal
from ..functions.process import finish, process
from ..functions.split import escaped, restored, split
from .kernels import Decoder, Encoder, encoded_parts

PART = "struct<text:string,special:bigint>"


@lru_cache(maxsize=8)
def _encoder(body: bytes) -> Encoder:
    return Encoder(pickle.loads(body))


@lru_cache(maxsize=8)
def _decoder(body: bytes, kinds: frozenset[str]) -> Decoder:
    return Decoder(pickle.loads(body), set(kinds))


@lru_cache(maxsize=8)
def _bytes_of(body: bytes) -> dict[int, bytes]:
    d = pickle.loads(body)
    return {s.id: s.bytes for s in d.specials} | dict(d.vocab)


def alternation(specials: list[Special]) -> str:
    """The first token in order that fits; where no token begins, one look at a character tells."""
    tokens = [s.bytes.decode() for s in specials if s.bytes]
    first = "".join(literal(c) for c in sorted({t[0] for t in tokens}))
    return f"(?=[{first}])(?:{'|'.join(map(literal, tokens))})"


def part(text: Column, special: Column | None = None) -> Column:
    return F.struct(text.alias("text"), (F.lit(None) if special is None else special).cast("bigint").alias("special"))


def special_id(text: Column, specials: list[Special], kinds: set[str] | None = None) -> Column:
    """The id of the special token that text spells, null for others and for kinds that aren't asked for."""
    known = {s.bytes.decode(): s.id for s in specials if kinds is None or s.kind in kinds}
    if not known:
        return F.lit(None).cast("bigint")
    return F.element_at(F.map_from_arrays(F.array(*map(F.lit, known)), F.array(*[F.lit(i).cast("bigint") for i in known.values()])), text)


def cut_special(text: Column, specials: list[Special], kinds: set[str], keep_cuts: bool) -> Column:
    """Parts of text at special tokens: array<struct<text, special>>.

    All of them take part in the match, so one that isn't asked for can hide another that overlaps it; its own cut stays only
    with keep_cuts.
    """
    if not specials:
        return F.array(part(text))
    marked = F.regexp_replace(escaped(text), alternation(specials), f"{CUT}$0{ESCAPE}{CUT}")
    unasked = [s for s in specials if s.kind not in kinds]
    if unasked and not keep_cuts:
        marked = F.regexp_replace(marked, f"{CUT}({alternation(unasked)}){ESCAPE}{CUT}", "$1")
    pieces = F.filter(F.split(marked, CUT), lambda x: x != "")

    def one(x: Column) -> Column:
        token = x.endswith(ESCAPE)
        bare = F.when(token, F.substring(x, F.lit(1), F.length(x) - 1)).otherwise(restored(x))
        return part(bare, F.when(token, special_id(bare, specials, kinds)))

    return F.transform(pieces, one)


def parts(text: Column, d: Definition, specials: bool | str | list[str] | None = True) -> Column:
    """What the model gets: array<struct<text, special>>, after cutting, normalizing and splitting."""
    kinds = d.kinds(specials)
    ordered = d.ordered_specials()
    early, late = [s for s in ordered if s.extract], [s for s in ordered if not s.extract]
    segments = cut_special(text, early, kinds, True)
    plain = F.transform(segments, lambda x: F.when(x["special"].isNull(), x["text"]))
    clean = normalized(plain, d.normalization)
    segments = F.zip_with(segments, clean, lambda x, y: part(F.coalesce(y, x["text"]), x["special"]))
    if late:
        segments = F.flatten(F.transform(segments, lambda x: F.when(x["special"].isNotNull(), F.array(x)).otherwise(cut_special(x["text"], late, kinds, False))))
    return F.flatten(F.transform(segments, lambda x: F.when(x["special"].isNotNull(), F.array(x)).otherwise(F.transform(split(x["text"], d.split), lambda y: part(y)))))


class Tokenizer:
    """encode and decode add a column to a DataFrame, of batch or stream; null gives null and empty text gives no ids."""

    def __init__(self, definition: Definition):
        self.definition = definition.validated()
        self._body = pickle.dumps(self.definition)

    def model(self, column: Column) -> Column:
        """ids of an array of parts."""
        body = self._body

        def run(batch: pa.Array) -> pa.Array:
            return encoded_parts(_encoder(body), batch)

        return F.arrow_udf(run, "array<bigint>")(column)

    def encode(self, df: DataFrame, text: str = "text", out: str = "tokens", specials: bool | str | list[str] | None = True) -> DataFrame:
        ids = self.model(parts(F.col(text), self.definition, specials))
        df = df.withColumn(out, ids)
        return df.withColumn(out, process(F.col(out), self.definition.processing)) if self.definition.processing else df

    def decode(self, df: DataFrame, ids: str = "tokens", out: str = "bytes", specials: bool | str | list[str] | None = True) -> DataFrame:
        body, kinds = self._body, frozenset(self.definition.kinds(specials))

        def run(batch: pa.Array) -> pa.Array:
            return _decoder(body, kinds).rows(batch)

        return df.withColumn(out, F.arrow_udf(run, "binary")(F.col(ids))).withColumn(out, finish(F.col(out), self.definition.decoding))

    def encode_distinct(self, df: DataFrame, key: str, text: str = "text", out: str = "tokens", specials: bool | str | list[str] | None = True) -> DataFrame:
        """The column that ``encode`` adds, by way of the distinct parts of the whole table; ``key`` is unique and not null."""
        placed = df.select(key, F.posexplode(parts(F.col(text), self.definition, specials)).alias("pos", "p")).select(key, "pos", F.col("p.text").alias("part"), "p.special")
        model = placed.select("part", "special").distinct().withColumn("ids", self.model(F.array(F.struct(F.col("part").alias("text"), "special"))))
        same = F.col("a.part").eqNullSafe(F.col("b.part")) & F.col("a.special").eqNullSafe(F.col("b.special"))
        found = placed.alias("a").join(model.alias("b"), same).select(f"a.{key}", F.struct("a.pos", "b.ids").alias("x"))
        rows = found.groupBy(key).agg(F.flatten(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["ids"])).alias(out))
        joined = df.join(rows, key, "left").withColumn(out, F.when(F.col(text).isNotNull(), F.coalesce(out, F.array().cast("array<bigint>"))))
        return joined.withColumn(out, process(F.col(out), self.definition.processing)) if self.definition.processing else joined

    def piece_counts(self, df: DataFrame, by: list[str], text: str = "text") -> DataFrame:
        """by, piece, n, tokens: how often each distinct part occurs and how many tokens it has."""
        pieces = df.select(*by, F.explode(parts(F.col(text), self.definition, False)).alias("p")).select(*by, F.col("p.text").alias("piece"), "p.special")
        counted = pieces.groupBy(*by, "piece", "special").agg(F.count("*").alias("n"))
        return counted.withColumn("tokens", F.size(self.model(F.array(F.struct(F.col("piece").alias("text"), "special"))))).drop("special")

    def tables(self, spark) -> tuple[DataFrame, DataFrame]:
        """vocab(id, bytes, rank, score) and specials(id, bytes, kind, ident, score, extract, ord)."""
        d = self.definition
        scores = d.scores or [None] * len(d.vocab)
        vocab = spark.createDataFrame([(i, bytearray(b), r, s) for r, ((i, b), s) in enumerate(zip(d.vocab, scores, strict=True))], "id long, bytes binary, rank int, score float")
        rows = [(s.id, bytearray(s.bytes), s.kind, s.ident, s.score, s.extract, k) for k, s in enumerate(d.ordered_specials())]
        return vocab, spark.createDataFrame(rows, "id long, bytes binary, kind string, ident string, score float, extract boolean, ord int")

    def register(self, spark, name: str = "tokens") -> None:
        """SQL functions encode_<name>(text) and decode_<name>(ids), without cutting at special tokens, and the table function
        pieces_<name>(text), which gives (pos, id, bytes) for each token of a text."""
        body = self._body

        def encode(batch: pa.Array) -> pa.Array:
            ones = pa.StructArray.from_arrays([batch, pa.nulls(len(batch), pa.int64())], ["text", "special"])
            rows = pa.ListArray.from_arrays(pa.array(range(len(batch) + 1), pa.int32()), ones, mask=batch.is_null())
            return encoded_parts(_encoder(body), rows)

        def decode(batch: pa.Array) -> pa.Array:
            return _decoder(body, frozenset(self.definition.kinds(True))).rows(batch)

        spark.udf.register(f"encode_{name}", F.arrow_udf(encode, "array<bigint>"))
        spark.udf.register(f"decode_{name}", F.arrow_udf(decode, "binary"))

        class Pieces:
            def eval(self, text: str):
                of = _bytes_of(body)
                for pos, i in enumerate(_encoder(body)(text) if text is not None else ()):
                    yield pos, i, of.get(i)

        spark.udtf.register(f"pieces_{name}", F.udtf(Pieces, returnType="pos int, id bigint, bytes binary"))

    def save(self, spark, path: str) -> None:
        """Tables vocab and specials as Parquet, and the rest as a line of JSON, under path."""
        vocab, specials = self.tables(spark)
        vocab.coalesce(1).write.mode("overwrite").parquet(f"{path}/vocab")
        specials.coalesce(1).write.mode("overwrite").parquet(f"{path}/specials")
        rest = replace(self.definition, vocab=(), scores=(), specials=()).to_json()
        spark.createDataFrame([(rest,)], "value string").write.mode("overwrite").text(f"{path}/config")

    @classmethod
    def saved(cls, spark, path: str) -> Tokenizer:
        """What save wrote, from any store that Spark reads."""
        body = json.loads(spark.read.text(f"{path}/config").first()["value"])
        vocab = spark.read.parquet(f"{path}/vocab").orderBy("rank").collect()
        body["vocab"] = [[r["id"], bytes(r["bytes"]).hex()] for r in vocab]
        body["scores"] = [r["score"] for r in vocab if r["score"] is not None]
        body["specials"] = [{k: r[k] for k in ("id", "kind", "ident", "score", "extract")} | {"bytes": bytes(r["bytes"]).hex()} for r in spark.read.parquet(f"{path}/specials").orderBy("ord").collect()]
        return cls(Definition.from_json(json.dumps(body)))
