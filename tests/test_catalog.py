"""Every registered query of the tokenizer operators against its DuckDB SQL, and streams against batches."""

import os

import duckdb
import pytest
import regex

from tokenloom.plans import catalog
from tokenloom.sources.formats import CL100K, O200K

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "events"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = sorted(tuple(map(str, r)) for r in df.collect())
    cols = ", ".join(f'"{c}"' for c in df.columns)
    assert got == sorted(tuple(map(str, r)) for r in duck.sql(f"SELECT {cols} FROM ({catalog.ORACLES[name]})").fetchall())


@pytest.mark.parametrize(("name", "pattern"), [("split_cl100k_regex", CL100K), ("split_o200k_regex", O200K)])
def test_patterns_beyond_re2(spark, name, pattern):
    """Another engine finds the same pieces; what lies between matches is a piece as well."""
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in catalog.QUERIES[name](spark, SF).collect():
        want, at = [], 0
        for m in regex.finditer(pattern, text[r["doc_id"]], regex.V1):
            want += [text[r["doc_id"]][at : m.start()], m.group()]
            at = m.end()
        assert r["out"] == catalog.BAR.join(x for x in [*want, text[r["doc_id"]][at:]] if x)


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs.write.parquet(str(tmp_path / "in"))
    stream = catalog.BPE.encode(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("encoded").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(str, spark.table("encoded").collect())) == sorted(map(str, catalog.BPE.encode(docs).collect()))


@pytest.mark.parametrize("form", ["NFC", "NFD", "NFKC", "NFKD"])
def test_unicode_forms(spark, form):
    """The documents, and vectors of the kinds that the forms tell apart, against the standard library."""
    import unicodedata

    vectors = ["e\u0301", "\u00e9", "\ufb01", "\u1e9b\u0323", "\uac00", "\u1100\u1161", "\u2460", "\uff21", "q\u0307\u0323", "\u212b", ""]
    docs = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()] + vectors
    df = spark.createDataFrame(list(enumerate(docs)) + [(-1, None)], "n int, text string")
    got = {r["n"]: r["out"] for r in df.select("n", catalog.normalize(catalog.F.col("text"), (catalog.step("unicode", form=form),)).alias("out")).collect()}
    assert got.pop(-1) is None and all(got[i] == unicodedata.normalize(form, t) for i, t in enumerate(docs))


def test_conditional_at_the_end(spark):
    from tokenloom.functions.normalize import normalized

    one = catalog.step("conditional", position="end", step={"name": "append", "args": {"text": "!"}})
    row = spark.createDataFrame([(["a", None, "b"], [""])], "x array<string>, y array<string>").select(*[normalized(catalog.F.col(c), (one,)).alias(c) for c in "xy"]).first()
    assert row["x"] == ["a", None, "b!"] and row["y"] == [""]


def test_distinct_plan_equals_row_plan(spark):
    """Special tokens, nulls, empty texts and post-processing included."""
    d = catalog.replace(catalog.BPE.definition, specials=catalog.MARKS, processing=(catalog.step("truncate", length=30),))
    tok = catalog.Tokenizer(d)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "the and License")], "doc_id long, text string"))
    rows = lambda df: sorted(map(str, df.select("doc_id", "tokens").collect()))
    assert rows(tok.encode(docs)) == rows(tok.encode_distinct(docs, "doc_id"))


@pytest.mark.parametrize("window", [{}, {"width": "2 hours", "slide": "1 hour"}, {"gap": "20 minutes"}])
def test_streamed_windows_and_late_rows(spark, tmp_path, window):
    """Files in turn; a row of the fourth is older than the watermark of two batches before and is left out."""
    at = lambda h, m: f"2024-01-01 {h:02}:{m:02}:00"
    files = [[(at(1, 5), "the"), (at(1, 20), "and"), (at(3, 0), "sun")], [(at(5, 50), "rain"), (at(6, 0), "")], [(at(7, 0), "later")], [(at(1, 10), "toolate"), (at(6, 10), "x"), (at(12, 0), "end")], [(at(20, 0), "last")]]
    schema = "ts timestamp, event_type string, who int"
    frame = lambda rows: spark.createDataFrame(rows, "ts string, event_type string").selectExpr("CAST(ts AS timestamp) AS ts", "event_type", "1 AS who")
    for i, rows in enumerate(files):
        frame(rows).coalesce(1).write.parquet(str(tmp_path / f"f{i}"))
        for path in (tmp_path / f"f{i}").glob("*.parquet"):
            os.utime(path, (1_700_000_000 + 60 * i,) * 2)
    window = window | {"by": ("who",)}
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path))
    name = "windows" + "_".join(window)
    q = catalog.token_windows(stream, catalog.EVENT, "event_type", "ts", **window).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(map(tuple, spark.table(name).collect()))
    kept = frame([r for rows in files for r in rows if r[1] != "toolate"])
    want = sorted(map(tuple, catalog.token_windows(kept, catalog.EVENT, "event_type", "ts", **window).collect()))
    # The last windows stay open: no later row closes them.
    assert got == [w for w in want if w[1].hour < 18]
