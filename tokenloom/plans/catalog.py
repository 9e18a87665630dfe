"""Registered queries of the tokenizer operators, each with DuckDB SQL that reaches the same result another way."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import replace
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..definition import Definition, Special, Step, step
from ..functions.normalize import ALL, charsmap_blob, normalize
from ..functions.process import finish, ids_of, process, text_of
from ..functions.split import split
from ..operators import vocabulary as V
from ..operators.tokenizer import Tokenizer, parts
from ..sources.formats import CL100K, O200K
from ..streaming.encode import token_windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: A small rank-ordered vocabulary in which merges chain, for single texts; queries over documents take theirs from the corpus.
LETTERS = list("abcdefghijklmnopqrstuvwxyz")
VOCAB = LETTERS + ["th", "he", "in", "er", "an", "on", "re", "es", "en", "the", "and", "ing", "tion", "ti", "nd", "ha", "ent", "tha", "her", "ou", "sh", "st"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def sql_list(items: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


def on_text(name: str, make: Callable[[Column], Column], oracle: str | None) -> None:
    """A query of doc_id and one column ``out`` made from text."""
    QUERIES[name] = lambda spark, sf: docs(spark, sf).select("doc_id", make(F.col("text")).alias("out"))
    if oracle:
        ORACLES[name] = f"SELECT doc_id, {oracle} AS out FROM documents"


# Normalization -------------------------------------------------------------------------------------------------------------


def norm(name: str, oracle: str | None, *steps: Step) -> None:
    on_text(name, lambda c: normalize(c, steps), oracle)


norm("norm_casefold", "lower(text)", step("casefold"))
norm("norm_casefold_upper", "upper(replace(text, 'ß', 'ss'))", step("replace", old="ß", new="ss"), step("casefold", upper=True))
norm("norm_append", "CASE WHEN text = '' THEN '' ELSE text || '</s>' END", step("append", text="</s>"))
norm("norm_prepend", "CASE WHEN text = '' THEN '' ELSE '<s>' || text END", step("prepend", text="<s>"))
norm("norm_extend", "CASE WHEN text = '' THEN '' ELSE '..' || text || '.' END", step("extend", ch=".", left=2, right=1))
norm("norm_extend_pad", "CASE WHEN text = '' THEN '' WHEN suffix(text, '..') THEN text WHEN suffix(text, '.') THEN text || '.' ELSE text || '..' END", step("extend", ch=".", left=0, right=2, pad=True))
norm("norm_strip", "rtrim(CASE WHEN prefix(text, 'T') THEN text[2:] ELSE text END, '.')", step("strip", ch="T", left=1, right=0), step("strip", ch=".", left=0, right=ALL))
norm("norm_collapse", "regexp_replace(text, 'e+', 'e', 'g')", step("collapse", ch="e"))
norm("norm_replace_str", "array_to_string(string_split(text, 'the'), 'THE')", step("replace", old="the", new="THE"))
norm("norm_replace_regex", r"regexp_replace(text, '([a-z])(n)', '\2\1', 'g')", step("replace_regex", pattern="([a-z])(n)", new="$2$1"))
norm("norm_nmt", "translate(text, chr(10) || chr(9601), '  ')", step("nmt"))
norm("norm_nfc", "nfc_normalize(text)", step("unicode", form="NFC"))
norm("norm_nfd", None, step("unicode", form="NFD"))
norm("norm_nfkc", None, step("unicode", form="NFKC"))
norm("norm_nfkd", None, step("unicode", form="NFKD"))
CHANGES = {"ß": "ss", "é": "e", "ä": "ae", "th": "þ", "ü": "ue", "q": ""}
norm("norm_charsmap", "regexp_replace(replace(replace(replace(replace(text, 'ß', 'ss'), 'é', 'e'), 'ä', 'ae'), 'ü', 'ue'), 'q', '', 'g')", step("charsmap", blob=charsmap_blob(CHANGES).hex()))
norm("norm_conditional", "CASE WHEN text = '' THEN '' ELSE '_' || text END", step("conditional", position="start", step={"name": "prepend", "args": {"text": "_"}}))

# Splits --------------------------------------------------------------------------------------------------------------------

BAR = "¦"


def cuts(name: str, oracle: str | None, *steps: Step) -> None:
    on_text(name, lambda c: F.array_join(split(c, steps), BAR), oracle)


def cut(pattern: str, behaviour: str, kind: str = "regex") -> Step:
    return step("split", kind=kind, pattern=pattern, behaviour=behaviour)


def pieces_sql(pattern: str) -> str:
    """All matches of an RE2 pattern joined by the bar: the oracle's way to any split is one covering pattern."""
    return f"array_to_string(regexp_extract_all(text, '{pattern}'), '{BAR}')"


cuts("split_match", pieces_sql("[a-z]+"), cut("[a-z]+", "match"))
cuts("split_remove", pieces_sql("[^ ]+"), cut("[ ]", "remove"))
cuts("split_isolate", pieces_sql("[ ]|[^ ]+"), cut("[ ]", "isolate"))
cuts("split_merge", pieces_sql("[ ]+|[^ ]+"), cut("[ ]", "merge"))
cuts("split_merge_left", pieces_sql("[^ ]*[ ]|[^ ]+"), cut("[ ]", "merge_left"))
cuts("split_merge_right", pieces_sql("[ ][^ ]*|[^ ]+"), cut("[ ]", "merge_right"))
cuts("split_char", pieces_sql("[^.]+"), cut(".", "remove", "char"))
cuts("split_string", "array_to_string(list_filter(string_split(text, 'the'), lambda x: x <> ''), '" + BAR + "')", cut("the", "remove", "string"))
cuts("split_chain", pieces_sql("[ ]|[^ t]*t|[^ t]+"), cut("[ ]", "isolate"), cut("t", "merge_left", "char"))


def mixed(text: Column) -> Column:
    """Words of other scripts among the text's own."""
    for old, new in MIXED.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


#: Stand-ins of six scripts, two of them neighbours without a space.
MIXED = {"the": "тхе", "and": "αντ", "ing": "ఇంకಇಂಕ", "der": "дер漢字", "que": "קוו"}
SCRIPTS = "(?s)(?:^[\\p{Common}]*)?(?:" + "|".join(f"\\p{{{x}}}[\\p{{{x}}}\\p{{Common}}]*" for x in ("Latin", "Cyrillic", "Greek", "Telugu", "Kannada", "Han", "Hebrew", "Inherited")) + ")"
QUERIES["split_unicode_script"] = lambda spark, sf: docs(spark, sf).select("doc_id", F.array_join(split(mixed(F.col("text")), (step("scripts"),)), BAR).alias("out"))
MIXED_SQL = "text"
for _old, _new in MIXED.items():
    MIXED_SQL = f"replace({MIXED_SQL}, '{_old}', '{_new}')"
ORACLES["split_unicode_script"] = f"SELECT doc_id, CASE WHEN len(p) = 0 THEN t ELSE array_to_string(p, '{BAR}') END AS out FROM (SELECT doc_id, t, regexp_extract_all(t, '{SCRIPTS}') AS p FROM (SELECT doc_id, {MIXED_SQL} AS t FROM documents))"
GPT2_RE2 = r"''s|''t|''re|''ve|''m|''ll|''d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
cuts("split_gpt2_regex", pieces_sql(GPT2_RE2), cut(GPT2_RE2.replace("''", "'"), "isolate"))
# DuckDB has neither look-ahead nor possessive repeats; tests compare these with another regex engine.
cuts("split_cl100k_regex", None, cut(CL100K, "isolate"))
cuts("split_o200k_regex", None, cut(O200K, "isolate"))

# Special tokens ------------------------------------------------------------------------------------------------------------

MARKS = (Special(1000, b"License", "control", 0.0, True), Special(1001, b"the ", "unknown", 1.0, False), Special(1002, b"and", "priority", 2.0, False))
WORDS = Definition("bytepair", tuple((i, b.encode()) for i, b in enumerate(VOCAB)), specials=MARKS, split=(cut("[ ]", "isolate"),))


def special_parts(name: str, wanted: bool | list[str], pattern: str, ids: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        p = parts(F.col("text"), WORDS, wanted)
        marks = F.filter(p, lambda x: x["special"].isNotNull())
        return docs(spark, sf).select("doc_id", F.array_join(F.transform(marks, lambda x: x["special"].cast("string")), ",").alias("ids"), F.length(F.array_join(F.transform(p, lambda x: x["text"]), "")).cast("long").alias("chars"))

    QUERIES[name] = run
    ORACLES[name] = f"SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '{pattern}'), lambda x: {ids}), ',') AS ids, length(text) AS chars FROM documents"


special_parts("special_extract", ["control"], "License", "'1000'")
special_parts("special_post", True, "License|the |and", "CASE x WHEN 'License' THEN '1000' WHEN 'the ' THEN '1001' ELSE '1002' END")
special_parts("special_kinds", ["priority"], "and", "'1002'")

# Models over a vocabulary of the corpus ------------------------------------------------------------------------------------

#: Runs of Latin letters with a space before them, and every other character by itself: together the whole text.
LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
WHOLE = f"[ ]?[{LETTER}]+|[^{LETTER}]"
#: Frequent runs of two and three characters, and frequent words, that join the characters as tokens.
TOP = {2: 64, 3: 48, 4: 64}
UNKNOWN = 100_000
UNK = Special(UNKNOWN, b"[UNK]", "unknown")
SPLIT = (cut(WHOLE, "isolate"),)


@lru_cache(maxsize=8)
def _corpus(app: str, sf: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Characters in order, then the most frequent runs of 2 and 3 characters, then words of 4 characters or more."""
    spark = SparkSession.getActiveSession()
    words = docs(spark, sf).select(F.explode(F.regexp_extract_all("text", F.lit(WHOLE), F.lit(0))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    size = F.length("w")
    run = lambda k: F.when(size >= k, F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: F.struct(F.lit(k).alias("kind"), F.substring(F.col("w"), i, F.lit(k)).alias("token"))))
    whole = F.when(size >= 4, F.array(F.struct(F.lit(4).alias("kind"), F.col("w").alias("token"))))
    none = F.array().cast("array<struct<kind:int,token:string>>")
    runs = words.select("n", F.explode(F.concat(*[F.coalesce(x, none) for x in (run(1), run(2), run(3), whole)])).alias("x")).groupBy("x.kind", "x.token").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.col("n").desc(), "token"))
    top = runs.where("kind > 1").withColumn("place", place).where("place <= CASE kind " + " ".join(f"WHEN {k} THEN {n}" for k, n in TOP.items()) + " END")
    chars = tuple(sorted(r["token"] for r in runs.where("kind = 1").select("token").collect()))
    return chars, tuple(r["token"] for r in top.orderBy("kind", "place").collect())


def corpus(spark: SparkSession, sf: str) -> tuple[list[str], list[str]]:
    chars, grams = _corpus(spark.sparkContext.applicationId, sf)
    return list(chars), list(grams)


CORPUS_SQL = f"""spots AS MATERIALIZED (SELECT doc_id, unnest(p) AS word, generate_subscripts(p, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '{WHOLE}') AS p FROM documents)),
counted AS MATERIALIZED (SELECT word, count(*) AS n FROM spots GROUP BY word),
distinct_words AS MATERIALIZED (SELECT word FROM counted),
grams AS (SELECT kind, token, sum(n) AS n FROM (
  SELECT kind, word[unnest(range(1, length(word) - kind + 2)):] AS rest, n, kind AS k FROM counted, (SELECT unnest([1, 2, 3]) AS kind) WHERE length(word) >= kind) t, LATERAL (SELECT t.rest[:t.k] AS token) GROUP BY kind, token
  UNION ALL SELECT 4, word, n FROM counted WHERE length(word) >= 4),
ranked AS (SELECT kind, token, row_number() OVER (PARTITION BY kind ORDER BY n DESC, token) AS place FROM grams),
lists AS MATERIALIZED (SELECT (SELECT list(token ORDER BY token) FROM ranked WHERE kind = 1) AS chars,
  (SELECT list(token ORDER BY kind, place) FROM ranked WHERE kind > 1 AND place <= CASE kind WHEN 2 THEN {TOP[2]} WHEN 3 THEN {TOP[3]} ELSE {TOP[4]} END) AS grams)"""


def definition(model: str, tokens: list[str], **more) -> Definition:
    return Definition(model, tuple((i, b.encode()) for i, b in enumerate(tokens)), split=SPLIT, **more)


def unigram_scores(tokens: list[str]) -> tuple[float, ...]:
    return tuple(-8.0 if len(b) == 1 else -9.5 - i / 128 for i, b in enumerate(tokens))


def short(chars: list[str], grams: list[str]) -> list[str]:
    return chars + [g for g in grams if len(g) <= 4]


def with_gaps(tokens: list[str]) -> list[str]:
    """Without some characters, for what happens to units that have no token."""
    return [x for x in tokens if x not in GAPS]


def word_pieces(chars: list[str], grams: list[str]) -> list[str]:
    return chars + grams + ["##" + c for c in chars if re.fullmatch(f"[{LETTER}]", c)] + ["##" + g for g in grams if g[0] != " "]


GAPS = ("k", "w", "g", "é", ".")
STIFF = ("##e", "t", "##an")
FALL = {"specials": (UNK,), "fallback": ("unknown", "skip")}
Make = Callable[[list[str], list[str]], Definition]
#: The model of each query as a function of the corpus's characters and runs.
MODELS: dict[str, Make] = {
    "bpe_encode_chars": lambda c, g: definition("bytepair", c + g),
    "bpe_encode_bytes": lambda c, g: definition("bytepair", [x for x in c if ord(x) < 0x800] + g, chars=False),
    "bpe_whole_part": lambda c, g: definition("bytepair", [x for x in g if len(x) > 3]),
    "bpe_end_of_word": lambda c, g: definition("bytepair", c + g + [x + "</w>" for x in c + g], word_end="</w>", **FALL),
    "bpe_unk_fallback": lambda c, g: definition("bytepair", with_gaps(c + g), **FALL),
    "bpe_skip_fallback": lambda c, g: definition("bytepair", with_gaps(c + g)),
    "bpe_byte_fallback": lambda c, g: replace(d := definition("bytepair", [x for x in c + g if x.isascii()], fallback=("bytes", "skip")), vocab=d.vocab + tuple((UNKNOWN + b, bytes([b])) for b in range(128, 256))),
    "wordpiece_encode": lambda c, g: definition("wordpiece", word_pieces(c, g), max_word_chars=18, word_continuation="##", **FALL),
    "wordpiece_unk": lambda c, g: definition("wordpiece", [x for x in word_pieces(c, g) if x not in STIFF], max_word_chars=18, word_continuation="##", **FALL),
    "wordpiece_maxchars": lambda c, g: definition("wordpiece", word_pieces(c, g), max_word_chars=5, word_continuation="##", **FALL),
    "unigram_encode": lambda c, g: definition("unigram", t := short(c, g), scores=unigram_scores(t)),
    "unigram_unk": lambda c, g: definition("unigram", t := with_gaps(short(c, g)), scores=unigram_scores(t), **FALL),
    "decode_prefix": lambda c, g: definition("wordpiece", word_pieces(c, g), word_continuation="##"),
    "decode_skip_specials": lambda c, g: replace(definition("bytepair", c + g), specials=(Special(UNKNOWN, b"the", "control", 0.0, True),)),
    "roundtrip": lambda c, g: Definition("bytepair", tuple((b, bytes([b])) for b in range(256)) + tuple((256 + i, x.encode()) for i, x in enumerate(g)), chars=False, split=SPLIT),
}


def model(spark: SparkSession, sf: str, name: str) -> Tokenizer:
    return Tokenizer(MODELS[name](*corpus(spark, sf)))


BPE = Tokenizer(Definition("bytepair", tuple((i, b.encode()) for i, b in enumerate(VOCAB)), split=(cut("[a-z]+", "match"),)))
BPE_END = Tokenizer(Definition("bytepair", tuple((i, b.encode()) for i, b in enumerate([*VOCAB, "e</w>", "the</w>"])), specials=(UNK,), fallback=("unknown", "skip"), split=(cut("[a-z]+", "match"),), word_end="</w>"))
PIECE = Tokenizer(Definition("wordpiece", tuple((i, b.encode()) for i, b in enumerate([*LETTERS, *("##" + x for x in LETTERS)])), max_word_chars=18, specials=(UNK,), fallback=("unknown", "skip"), split=(cut("[a-z]+", "match"),), word_continuation="##"))
UNI = Tokenizer(Definition("unigram", tuple((i, b.encode()) for i, b in enumerate(VOCAB)), unigram_scores(VOCAB), split=(cut("[a-z]+", "match"),)))
BYTES_LEFT = Tokenizer(Definition("bytepair", tuple((i, b.encode()) for i, b in enumerate(VOCAB)) + tuple((300 + b, bytes([b])) for b in range(128, 256)), fallback=("bytes", "skip"), split=(cut("[a-zà-ÿ]+", "match"),)))


def ids_text(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")


BY_DOCUMENT = """SELECT d.doc_id, coalesce(array_to_string(flatten(list(w.ids ORDER BY a.pos)), ','), '') AS ids
FROM documents d LEFT JOIN spots a USING (doc_id) LEFT JOIN words w USING (word) GROUP BY d.doc_id"""


def per_word(vocab: str, solve: str, final: str = BY_DOCUMENT) -> str:
    """vocab: SQL for the list of tokens, of chars and grams.  solve: CTEs that end in words(word, ids) for ``distinct_words``."""
    return f"WITH RECURSIVE {CORPUS_SQL},\nvv AS MATERIALIZED (SELECT {vocab} AS v FROM lists), {solve}\n{final}"


ALL_SQL = "chars || grams"


def bpe_words(end: str = "", missing: str = "[]") -> str:
    """missing: the ids, as a list, of a unit u without a token."""
    units = "regexp_extract_all(word, '(?s).')"
    if end:
        units = f"list_append({units}[:-2], right(word, 1) || '{end}')"
    return f"""
m(word, units, found) AS (
  SELECT word, CASE WHEN list_contains(v, word || '{end}') THEN [word || '{end}'] ELSE {units} END, 1 FROM distinct_words, vv
  UNION ALL
  SELECT word, units[:i - 1] || [units[i] || units[i + 1]] || units[i + 2:], 1 FROM (
    SELECT word, units, list_position(ranks, list_min(ranks)) AS i, list_min(ranks) AS best FROM (
      SELECT word, units, list_transform(range(1, len(units)), lambda k: list_position(v, units[k] || units[k + 1])) AS ranks FROM m, vv))
  WHERE best IS NOT NULL),
words AS (SELECT word, flatten(list_transform(u1, lambda u: CASE WHEN list_contains(v, u) THEN [list_position(v, u) - 1] ELSE {missing} END)) AS ids FROM (SELECT word, arg_min(units, len(units)) AS u1 FROM m GROUP BY word), vv)"""


def unigram_words() -> str:
    """Dynamic programming over ends; the last four costs and paths are all that a token of at most four characters needs."""
    part = "word[e + 2 - n:e + 1]"
    price = f"CASE WHEN list_contains(v, {part}) THEN CASE WHEN n = 1 THEN 8.0 ELSE 9.5 + (list_position(v, {part}) - 1) / 128 END END"
    return f"""
g(word, e, costs, paths) AS (
  SELECT word, 0, [0.0::DOUBLE], [[]::INT[]] FROM distinct_words
  UNION ALL
  SELECT word, e + 1, (costs || [coalesce(best, 1000000.0)])[-4:], (paths || [paths[-n] || [coalesce(list_position(v, {part}) - 1, {UNKNOWN})::INT]])[-4:] FROM (
    SELECT *, coalesce(list_max(list_filter(range(1, least(4, e + 1) + 1), lambda n: cand[n] = best)), 1) AS n FROM (
      SELECT *, list_min(cand) AS best FROM (
        SELECT word, e, costs, paths, v, list_transform(range(1, least(4, e + 1) + 1), lambda n: (costs[-n] + {price})::DOUBLE) AS cand FROM g, vv WHERE e < length(word))))),
words AS (SELECT word, paths[-1] AS ids FROM g WHERE e = length(word))"""


def piece_words(most: int = 18) -> str:
    return f"""
g(word, pos, ids) AS (
  SELECT word, 1, []::INT[] FROM distinct_words WHERE length(word) <= {most}
  UNION ALL
  SELECT word, pos + n, list_append(ids, list_position(v, CASE WHEN pos = 1 THEN '' ELSE '##' END || word[pos:pos + n - 1]) - 1) FROM (
    SELECT word, pos, ids, v, list_max(list_filter(range(1, length(word) - pos + 2), lambda n: list_contains(v, CASE WHEN pos = 1 THEN '' ELSE '##' END || word[pos:pos + n - 1]))) AS n FROM g, vv WHERE pos <= length(word))
  WHERE n IS NOT NULL),
words AS (SELECT d.word, coalesce(any_value(g.ids), [{UNKNOWN}]) AS ids FROM distinct_words d LEFT JOIN g ON g.word = d.word AND g.pos = length(d.word) + 1 GROUP BY d.word)"""


def encodes(name: str, oracle: str) -> None:
    QUERIES[name] = lambda spark, sf: model(spark, sf, name).encode(docs(spark, sf).select("doc_id", "text"), specials=False).select("doc_id", ids_text(F.col("tokens")).alias("ids"))
    ORACLES[name] = oracle


PIECES_SQL = f"chars || grams || list_transform(list_filter(chars, lambda x: regexp_full_match(x, '[{LETTER}]')), lambda x: '##' || x) || list_transform(list_filter(grams, lambda x: x[1] <> ' '), lambda x: '##' || x)"
SHORT_SQL = "chars || list_filter(grams, lambda x: length(x) <= 4)"
#: The bytes of u as ids, by its hexadecimal digits.
HEX_SQL = f"list_transform(range(1, len(hex(encode(u))), 2), lambda i: {UNKNOWN} + 16 * (strpos('0123456789ABCDEF', hex(encode(u))[i]) - 1) + strpos('0123456789ABCDEF', hex(encode(u))[i + 1]) - 1)"
NO_GAPS = f"list_filter({{}}, lambda x: NOT list_contains({sql_list(list(GAPS))}, x))"
encodes("bpe_whole_part", per_word("list_filter(grams, lambda x: length(x) > 3)", "words AS (SELECT word, CASE WHEN list_contains(v, word) THEN [list_position(v, word) - 1] ELSE [] END AS ids FROM distinct_words, vv)"))
encodes("bpe_encode_chars", per_word(ALL_SQL, bpe_words()))
encodes("bpe_end_of_word", per_word(f"{ALL_SQL} || list_transform({ALL_SQL}, lambda x: x || '</w>')", bpe_words("</w>", f"[{UNKNOWN}]")))
encodes("bpe_encode_bytes", per_word("list_filter(chars, lambda x: unicode(x) < 2048) || grams", bpe_words()))
encodes("bpe_unk_fallback", per_word(NO_GAPS.format(ALL_SQL), bpe_words(missing=f"[{UNKNOWN}]")))
encodes("bpe_skip_fallback", per_word(NO_GAPS.format(ALL_SQL), bpe_words()))
encodes("bpe_byte_fallback", per_word(f"list_filter({ALL_SQL}, lambda x: length(x) = strlen(x))", bpe_words(missing=HEX_SQL)))
encodes("wordpiece_encode", per_word(PIECES_SQL, piece_words()))
encodes("wordpiece_unk", per_word(f"list_filter({PIECES_SQL}, lambda x: NOT list_contains({sql_list(list(STIFF))}, x))", piece_words()))
encodes("wordpiece_maxchars", per_word(PIECES_SQL, piece_words(5)))
encodes("unigram_encode", per_word(SHORT_SQL, unigram_words()))
encodes("unigram_unk", per_word(NO_GAPS.format(f"({SHORT_SQL})"), unigram_words()))
QUERIES["bpe_encode_distinct"] = lambda spark, sf: model(spark, sf, "bpe_encode_chars").encode_distinct(docs(spark, sf).select("doc_id", "text"), "doc_id", specials=False).select("doc_id", ids_text(F.col("tokens")).alias("ids"))
ORACLES["bpe_encode_distinct"] = ORACLES["bpe_encode_chars"]

# Processing and decoding ---------------------------------------------------------------------------------------------------

LENGTHS = "list_transform(list_filter(regexp_split_to_array(text, '[^a-zA-Z]+'), lambda x: x <> ''), lambda x: length(x))"


def lengths(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, "[^a-zA-Z]+"), lambda x: x != ""), lambda x: F.length(x).cast("long"))


def processes(name: str, s: Step, oracle: str) -> None:
    QUERIES[name] = lambda spark, sf: docs(spark, sf).select("doc_id", lengths(F.col("text")).alias("a")).select("doc_id", ids_text(process(F.col("a"), (s,))).alias("ids"))
    ORACLES[name] = f"SELECT doc_id, coalesce(array_to_string({oracle}, ','), '') AS ids FROM (SELECT doc_id, {LENGTHS} AS a FROM documents)"



def ids_as_text(spark: SparkSession, sf: str) -> DataFrame:
    """Ids written as text with mixed separators, read back and written again."""
    a = docs(spark, sf).select("doc_id", F.concat_ws(", ", F.transform(lengths(F.col("text")), lambda x: F.concat(x.cast("string"), F.lit("\n")))).alias("t"))
    return a.select("doc_id", text_of(ids_of(F.col("t"))).alias("ids"))


QUERIES["ids_as_text"] = ids_as_text
ORACLES["ids_as_text"] = f"SELECT doc_id, coalesce(array_to_string({LENGTHS}, ' '), '') AS ids FROM documents"
processes("proc_strip", step("strip", id=3, left=1, right=1), "CASE WHEN len(a) = 0 THEN a WHEN len(a) = 1 AND a[1] = 3 THEN [] ELSE a[CASE WHEN a[1] = 3 THEN 2 ELSE 1 END:CASE WHEN a[-1] = 3 THEN len(a) - 1 ELSE len(a) END] END")
processes("proc_collapse", step("collapse", id=2), "list_transform(list_filter(range(1, len(a) + 1), lambda i: i = 1 OR a[i] <> 2 OR a[i - 1] <> 2), lambda i: a[i])")
processes("proc_pad", step("pad", id=0, length=200, stride=8), "CASE WHEN len(a) = 0 OR len(a) >= 200 THEN a ELSE a || list_transform(range(0, ((200 - len(a) + 7) // 8) * 8), lambda i: 0) END")
processes("proc_truncate", step("truncate", length=100, stride=8), "CASE WHEN len(a) <= 100 THEN a ELSE a[:greatest(0, len(a) - ((len(a) - 100 + 7) // 8) * 8)] END")


def decodes(name: str, of: str, oracle: str, specials: bool | list[str] = True) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        tok = model(spark, sf, of)
        coded = tok.encode(docs(spark, sf).select("doc_id", "text"), specials=True)
        return tok.decode(coded, specials=specials).select("doc_id", F.col("bytes").cast("string").alias("out"))

    QUERIES[name] = run
    ORACLES[name] = f"SELECT doc_id, coalesce({oracle}, '') AS out FROM documents"


decodes("decode_direct", "bpe_encode_chars", "text")
decodes("decode_prefix", "decode_prefix", f"array_to_string(regexp_extract_all(text, '{WHOLE}'), ' ')")
decodes("decode_skip_specials", "decode_skip_specials", "replace(text, 'the', '')", ["unknown"])
decodes("roundtrip", "roundtrip", "text")


def finishes(name: str, s: Step, oracle: str) -> None:
    on_text(name, lambda c: finish(c.cast("binary"), (s,)).cast("string"), oracle)


finishes("decode_replace", step("replace", old="th", new="TH"), "array_to_string(string_split(text, 'th'), 'TH')")
finishes("decode_strip", step("strip", ch=".", left=0, right=1), "CASE WHEN suffix(text, '.') THEN text[:-2] ELSE text END")
finishes("decode_collapse", step("collapse", ch="e"), "regexp_replace(text, 'e+', 'e', 'g')")
finishes("decode_extend", step("extend", ch=" ", left=1, right=0, pad=True), "CASE WHEN text = '' OR prefix(text, ' ') THEN text ELSE ' ' || text END")

# Vocabularies as tables ----------------------------------------------------------------------------------------------------


def corpus_words(spark: SparkSession, sf: str) -> DataFrame:
    """token, n, id: distinct lower-case runs; the length serves as id."""
    words = docs(spark, sf).select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))).alias("token"))
    return words.groupBy("token").agg(F.count("*").alias("n")).withColumn("id", F.length("token").cast("long"))


WORDS_SQL = "w AS MATERIALIZED (SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[a-z]+')) AS token FROM documents) GROUP BY token)"


def vocab_merge_rank(spark: SparkSession, sf: str) -> DataFrame:
    w = corpus_words(spark, sf).where(F.length("token") >= 2)
    halves = w.select(F.substring("token", F.lit(1), F.lit(1)).alias("left"), F.substring("token", F.lit(2), F.lit(1)).alias("right"), F.col("n").alias("idx"))
    return V.merge_ranks(halves)


QUERIES["vocab_merge_rank"] = vocab_merge_rank
ORACLES["vocab_merge_rank"] = f"WITH {WORDS_SQL} SELECT token[:2] AS token, min(n) AS rank FROM w WHERE length(token) >= 2 GROUP BY 1"


def vocab_sp_merges(spark: SparkSession, sf: str) -> DataFrame:
    w = corpus_words(spark, sf)
    return V.piece_merges(w.select("token", F.col("n").cast("double").alias("score"), "id")).select("token", "merged")


QUERIES["vocab_sp_merges"] = vocab_sp_merges
ORACLES["vocab_sp_merges"] = f"""WITH {WORDS_SQL}, c AS MATERIALIZED (SELECT token, token[:k] AS a, token[k + 1:] AS b FROM (SELECT token, unnest(range(1, length(token))) AS k FROM w)),
m AS MATERIALIZED (SELECT DISTINCT c.token FROM c JOIN w l ON l.token = c.a JOIN w r ON r.token = c.b)
SELECT w.token, m.token IS NOT NULL AS merged FROM w LEFT JOIN m USING (token)"""


def vocab_dedup(spark: SparkSession, sf: str) -> DataFrame:
    w = corpus_words(spark, sf).select("token", F.substring("token", F.lit(1), F.lit(3)).alias("stem"))
    return V.first_of_equal(w, "stem", "token").select("stem", "token")


QUERIES["vocab_dedup"] = vocab_dedup
ORACLES["vocab_dedup"] = f"WITH {WORDS_SQL} SELECT token[:3] AS stem, min(token) AS token FROM w GROUP BY 1"


def vocab_byte_runes(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the words written as byte tokens; hex of the bytes that each stands for."""
    w = corpus_words(spark, sf)
    token = F.when(F.col("id") % 2 == 0, F.concat(F.lit("<0x4"), (F.col("id") % 10).cast("string"), F.lit(">"))).otherwise(F.col("token"))
    return w.select("token", F.hex(V.decoded_byte(token)).alias("bytes"))


QUERIES["vocab_byte_runes"] = vocab_byte_runes
ORACLES["vocab_byte_runes"] = f"WITH {WORDS_SQL} SELECT token, CASE WHEN length(token) % 2 = 0 THEN '4' || (length(token) % 10) ELSE hex(token) END AS bytes FROM w"


def vocab_special_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Letters as vocabulary, first pairs of letters as special tokens with ids from the second letter."""
    w = corpus_words(spark, sf)
    vocab = w.select(F.substring("token", 1, 1).alias("token")).distinct().select("token", (F.ascii("token") - 97).cast("long").alias("id"))
    pairs = w.where(F.length("token") >= 2).select(F.substring("token", 1, 2).alias("token")).distinct()
    return V.repaired_specials(pairs.select("token", (F.ascii(F.substring("token", 2, 1)) - 84).cast("long").alias("id"), F.col("token").alias("ord")), vocab).select("token", "id")


QUERIES["vocab_special_repair"] = vocab_special_repair
ORACLES["vocab_special_repair"] = f"""WITH {WORDS_SQL}, v AS (SELECT DISTINCT ascii(token) - 97 AS id FROM w), s AS (SELECT DISTINCT token[:2] AS token, ascii(token[2]) - 84 AS id FROM w WHERE length(token) >= 2),
top AS (SELECT max(id) AS most FROM v)
SELECT token, id::BIGINT AS id FROM s WHERE id NOT IN (FROM v) UNION ALL
SELECT token, (SELECT most FROM top) + row_number() OVER (ORDER BY token) FROM s WHERE id IN (FROM v)"""


def vocab_bpe_order(spark: SparkSession, sf: str) -> DataFrame:
    w = corpus_words(spark, sf).where(F.length("token") == 2).withColumn("id", F.ascii("token") * 256 + F.ascii(F.substring("token", 2, 1)))
    merges = w.where("n % 2 = 0").select(F.substring("token", 1, 1).alias("left"), F.substring("token", 2, 1).alias("right"), (F.col("n") * 100_000 + F.col("id")).alias("idx"))
    return V.bpe_order(w.select("token", "id"), merges).select("token", F.col("sort_rank").cast("long").alias("sort_rank"))


QUERIES["vocab_bpe_order"] = vocab_bpe_order
ORACLES["vocab_bpe_order"] = f"WITH {WORDS_SQL} SELECT token, row_number() OVER (ORDER BY n % 2, CASE WHEN n % 2 = 0 THEN n END, token) - 1 AS sort_rank FROM w WHERE length(token) = 2"


def vocab_without_specials(spark: SparkSession, sf: str) -> DataFrame:
    w = corpus_words(spark, sf)
    return V.without_specials(w.select("token", "n"), w.where("n = 1").select("token"))


QUERIES["vocab_without_specials"] = vocab_without_specials
ORACLES["vocab_without_specials"] = f"WITH {WORDS_SQL} SELECT token, n FROM w WHERE n > 1"


def by_lang(spark: SparkSession, sf: str, lang: str) -> DataFrame:
    words = docs(spark, sf).where(F.col("lang") == lang).select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))).alias("token")).distinct()
    return words.select(F.length("token").cast("long").alias("id"), "token")


QUERIES["vocab_diff"] = lambda spark, sf: V.difference(by_lang(spark, sf, "de"), by_lang(spark, sf, "fr"))
ORACLES["vocab_diff"] = """WITH l AS (SELECT DISTINCT lang, unnest(regexp_extract_all(text, '[a-z]+')) AS token FROM documents WHERE lang IN ('de', 'fr'))
SELECT length(token) AS id, token, CASE min(lang) WHEN 'de' THEN 'a' ELSE 'b' END AS side FROM l GROUP BY token HAVING count(*) = 1"""

# Analytics -----------------------------------------------------------------------------------------------------------------


BY_LANG = """SELECT lang, n_tokens, n_parts, n_chars FROM (SELECT d.lang, sum(len(w.ids))::BIGINT AS n_tokens, count(*) AS n_parts FROM documents d JOIN spots a USING (doc_id) JOIN words w USING (word) GROUP BY d.lang)
JOIN (SELECT lang, sum(length(text))::BIGINT AS n_chars FROM documents GROUP BY lang) USING (lang)"""
SIZED = "SELECT d.doc_id, any_value(d.lang) AS lang, any_value(d.source) AS source, coalesce(sum(len(w.ids)), 0)::BIGINT AS n FROM documents d LEFT JOIN spots a USING (doc_id) LEFT JOIN words w USING (word) GROUP BY d.doc_id"


def sized(spark: SparkSession, sf: str) -> DataFrame:
    return model(spark, sf, "bpe_encode_chars").encode(docs(spark, sf), specials=False).select("doc_id", "lang", "source", F.size("tokens").cast("long").alias("n"))


def analytic(name: str, run: Query, final: str) -> None:
    QUERIES[name] = run
    ORACLES[name] = per_word(ALL_SQL, bpe_words(), final)


def token_count_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    counts = model(spark, sf, "bpe_encode_chars").piece_counts(docs(spark, sf), ["lang"]).groupBy("lang").agg(F.sum(F.col("n") * F.col("tokens")).cast("long").alias("n_tokens"), F.sum("n").cast("long").alias("n_parts"))
    sizes = docs(spark, sf).groupBy("lang").agg(F.sum(F.length("text")).cast("long").alias("n_chars"))
    return sizes.join(counts, "lang").select("lang", "n_tokens", "n_parts", "n_chars")


def token_topk(spark: SparkSession, sf: str) -> DataFrame:
    ids = model(spark, sf, "bpe_encode_chars").encode(docs(spark, sf), specials=False).select(F.explode("tokens").alias("id"))
    return ids.groupBy("id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "id").limit(20)


def totals() -> list[Column]:
    return [F.sum("n").cast("long").alias("n_tokens"), F.count("*").alias("n_docs")]


N_SQL = "sum(n)::BIGINT AS n_tokens, count(*) AS n_docs"
analytic("token_count_by_lang", token_count_by_lang, BY_LANG)
analytic("token_topk", token_topk, "SELECT id::BIGINT AS id, count(*) AS n FROM (SELECT unnest(w.ids) AS id FROM spots a JOIN words w USING (word)) GROUP BY 1 ORDER BY n DESC, id LIMIT 20")
analytic("tokens_per_source_rollup", lambda spark, sf: sized(spark, sf).rollup("lang", "source").agg(*totals()), f"SELECT lang, source, {N_SQL} FROM ({SIZED}) GROUP BY ROLLUP (lang, source)")
analytic("tokens_per_source_cube", lambda spark, sf: sized(spark, sf).cube("lang", "source").agg(*totals()), f"SELECT lang, source, {N_SQL} FROM ({SIZED}) GROUP BY CUBE (lang, source)")
analytic("doc_truncation_stats", lambda spark, sf: sized(spark, sf).groupBy("lang").agg(F.sum((F.col("n") > 512).cast("long")).alias("cut"), F.sum(F.greatest(F.col("n") - 512, F.lit(0))).cast("long").alias("lost")), f"SELECT lang, count(*) FILTER (n > 512) AS cut, sum(greatest(n - 512, 0))::BIGINT AS lost FROM ({SIZED}) GROUP BY lang")
analytic("docs_ranked_by_tokens", lambda spark, sf: sized(spark, sf).withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy(F.col("n").desc(), "doc_id")).cast("long")).select("doc_id", "place", "n"), f"SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY n DESC, doc_id) AS place, n FROM ({SIZED})")


def distinct_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct parts of each language, exactly and by a sketch, which is within five percent (its error is two percent, typically)."""
    p = docs(spark, sf).select("lang", F.explode(split(F.col("text"), SPLIT)).alias("part"))
    counted = p.groupBy("lang").agg(F.countDistinct("part").alias("n_parts"), F.approx_count_distinct("part", 0.01).alias("about"))
    return counted.select("lang", "n_parts", (F.abs(F.col("about") - F.col("n_parts")) <= 0.05 * F.col("n_parts")).alias("sketch_is_close"))


QUERIES["distinct_parts_by_lang"] = distinct_parts
ORACLES["distinct_parts_by_lang"] = f"SELECT lang, count(DISTINCT part) AS n_parts, true AS sketch_is_close FROM (SELECT lang, unnest(regexp_extract_all(text, '{WHOLE}')) AS part FROM documents) GROUP BY lang"

EVENT = Tokenizer(Definition("bytepair", tuple((i, chr(i).encode()) for i in range(128)), split=SPLIT))


def events(name: str, oracle: str, **window) -> None:
    by = window.get("by", ())
    QUERIES[name] = lambda spark, sf: token_windows(table(spark, sf, "events"), EVENT, "event_type", "ts", **window).select(*by, F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n_tokens", "n_rows")
    ORACLES[name] = oracle


TOKENS_SQL = "sum(length(event_type))::BIGINT AS n_tokens, count(*) AS n_rows"
events("events_token_window", f"SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, {TOKENS_SQL} FROM events GROUP BY 1")
events("events_token_sliding", f"""SELECT strftime(start, '%Y-%m-%d %H:%M') AS start, {TOKENS_SQL} FROM (
  SELECT event_type, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS start FROM events) GROUP BY 1""", width="2 hours", slide="1 hour")
events("events_token_session", f"""SELECT user_id, strftime(start, '%Y-%m-%d %H:%M') AS start, n_tokens, n_rows FROM (SELECT user_id, min(ts) AS start, {TOKENS_SQL} FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 3 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, session)""", gap="3 hours", by=("user_id",))
