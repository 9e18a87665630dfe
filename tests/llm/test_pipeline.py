"""The pipeline's stages on nulls, repeated and null ids, copies, clashing columns, an empty table; and all of them in a row."""

import collections
import random

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline

EXTRA = "gone int, row int, kept int, n int, rank int, key string, label int, size int, copies int, head int, `a.b` int"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def fixture():
    rng = random.Random(11)
    fresh = lambda: " ".join(rng.choice(["sun", "rain", "tree", "walk", "stone", "cloud"]) + str(rng.randrange(900)) for _ in range(120))
    base = [fresh() for _ in range(30)]
    near = lambda t: t.rsplit(" ", 1)[0] + " changed"
    texts = [(i, t) for i, t in enumerate(base)]
    texts += [(100, base[0]), (101, base[1].replace(" ", "\n")), (102, near(base[2])), (3, near(base[4])), (None, fresh()), (None, near(base[5])), (7, fresh()), (103, None), (104, ""), (105, "too short"), (106, "again and again " * 60)]
    texts += [(200, "long " + " ".join(f"w{i}" for i in range(40_000)))]
    return [(i, t, "en", ["a", "b", None][k % 3], len(t or ""), 1, 2, 3, 4, 5, "k", 6, 7, 8, 9, 10) for k, (i, t) in enumerate(texts)], base, near


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_stages(spark):
    given, base, near = fixture()
    docs = spark.createDataFrame(given, SCHEMA).repartition(4)
    kept = corpus_pipeline.quality(spark, docs, "")
    assert kept.columns == docs.columns
    good = rows(kept)
    assert collections.Counter(good) == collections.Counter(r for r in given if r[1] and len(r[1].split()) >= 50 and not r[1].startswith("again"))
    again = spark.createDataFrame(good, SCHEMA)
    single = rows(corpus_pipeline.exact(spark, again, ""))
    assert collections.Counter(r[:2] for r in good) - collections.Counter(r[:2] for r in single) == collections.Counter([(100, base[0]), (101, base[1].replace(" ", "\n"))])
    apart = corpus_pipeline.near(spark, spark.createDataFrame(single, SCHEMA), "")
    assert apart.columns == docs.columns
    left = rows(apart)
    gone = collections.Counter(r[:2] for r in single) - collections.Counter(r[:2] for r in left)
    # Row 3 of base has the id of the near copy of base 4: of that pair the smaller id stays.
    assert gone == collections.Counter([(102, near(base[2])), (4, base[4]), (None, near(base[5]))])
    mix = corpus_pipeline.mix(spark, spark.createDataFrame(left, SCHEMA), "")
    assert mix.columns == docs.columns
    taken = collections.Counter(rows(mix))
    assert set(taken) <= set(left) and max(taken.values()) <= 2
    last = corpus_pipeline.encode(spark, spark.createDataFrame(list(taken.elements()), SCHEMA), "")
    assert last.columns[: len(docs.columns)] == docs.columns and all(bytes(r["decoded"]) == r["text"].encode() for r in last.collect())


def test_run_and_empty_table(spark, tmp_path):
    given, *_ = fixture()
    for name, some in (("full", given), ("none", [])):
        spark.createDataFrame(some, SCHEMA).write.parquet(str(tmp_path / name / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "full"))
    docs = spark.createDataFrame(given, SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), stage(spark, docs, "").schema) if stage is not corpus_pipeline.encode else stage(spark, docs, "")
    key = lambda r: (r["doc_id"], r["text"])
    assert collections.Counter(map(key, out.collect())) == collections.Counter(map(key, docs.collect()))
    none = corpus_pipeline.run(spark, str(tmp_path / "none"))
    assert none.collect() == [] and none.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
