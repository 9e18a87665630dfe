"""Command line, saved definitions, SQL functions."""

import random
from dataclasses import replace

import pytest

from tokenloom.__main__ import SUFFIX, differences, main
from tokenloom.definition import Special
from tokenloom.operators.tokenizer import Tokenizer
from tokenloom.plans import catalog
from tokenloom.sources.formats import from_bytes, to_bytes


@pytest.fixture()
def model(tmp_path):
    d = replace(catalog.BPE_END.definition, specials=(*catalog.BPE_END.definition.specials, Special(700, b"<end>", "control", 1.0, True)))
    path = tmp_path / "model"
    path.write_bytes(to_bytes(d))
    return d, str(path)


def test_command_line(spark, model, tmp_path, capsys):
    d, path = model
    (tmp_path / "in.txt").write_text("the rest\nand the end<end>")
    assert main(["encode", path, str(tmp_path / "in.txt")]) == 0
    ids = capsys.readouterr().out.strip()
    want = Tokenizer(d).encode(spark.createDataFrame([("the rest\nand the end<end>",)], "text string")).first()["tokens"]
    assert ids == " ".join(map(str, want)) and want[-1] == 700
    assert main(["decode", path, ids.replace(" ", ",\n", 2)]) == 0
    out = capsys.readouterr()
    assert out.out.endswith("<end>\n") and "no file" in out.err
    assert main(["inspect", path]) == 0
    assert '"<end>"' in capsys.readouterr().out
    assert main(["convert", path]) == 0
    with open(path + SUFFIX, "rb") as f:
        assert from_bytes(f.read()) == d
    assert main(["compare", path, path + SUFFIX]) == 0
    (tmp_path / "other").write_bytes(to_bytes(replace(d, vocab=((90, b"zz"), *d.vocab[1:]), specials=(), word_end="")))
    assert main(["compare", path, str(tmp_path / "other")]) == 1
    assert "vocabularies differ: 1 entries" in capsys.readouterr().out
    assert differences(d, d) == []
    assert main(["inspect", str(tmp_path / "none")]) == 1
    assert main(["encode", path, "x", "--column", "text"]) == 1


def test_command_line_on_tables(spark, model, tmp_path):
    d, path = model
    texts = [("the and",), (None,), ("",), ("in there<end>",)]
    spark.createDataFrame(texts, "text string").write.parquet(str(tmp_path / "t"))
    assert main(["encode", path, str(tmp_path / "t"), "--column", "text", "--out", str(tmp_path / "ids")]) == 0
    assert main(["decode", path, str(tmp_path / "ids"), "--column", "tokens", "--out", str(tmp_path / "back")]) == 0
    got = {r["text"]: r for r in spark.read.parquet(str(tmp_path / "back")).collect()}
    assert got[None]["tokens"] is None and got[None]["bytes"] is None
    assert got[""]["tokens"] == [] and got["in there<end>"]["tokens"][-1] == 700


@pytest.mark.parametrize("tok", [catalog.UNI, catalog.PIECE, catalog.BYTES_LEFT, catalog.BPE_END])
def test_saved_tables(spark, tok, tmp_path):
    tok.save(spark, str(tmp_path / "saved"))
    assert Tokenizer.saved(spark, str(tmp_path / "saved")).definition == tok.definition


def test_sql_functions(spark):
    catalog.BPE.register(spark, "test")
    rows = spark.sql("SELECT pos, id, CAST(bytes AS string) AS token FROM pieces_test('there')").collect()
    assert [r["pos"] for r in rows] == list(range(len(rows))) and "".join(r["token"] for r in rows) == "there"
    assert spark.sql("SELECT encode_test('there') AS a").first()["a"] == [r["id"] for r in rows]
    assert spark.sql("SELECT * FROM pieces_test(NULL)").collect() == []


def test_long_and_short_merging_agree():
    """Parts around the length at which the merging algorithm changes, against the plain definition."""
    from tokenloom.operators.kernels import merge_long, merge_short

    rng = random.Random(5)
    rank = {b.encode(): r for r, b in enumerate(catalog.VOCAB)}
    for n in (1, 2, 95, 96, 97, 300):
        units = [rng.choice("thenadi").encode() for _ in range(n)]
        plain = list(units)
        while True:
            joins = [(rank[plain[i] + plain[i + 1]], i) for i in range(len(plain) - 1) if plain[i] + plain[i + 1] in rank]
            if not joins:
                break
            i = min(joins)[1]
            plain[i : i + 2] = [plain[i] + plain[i + 1]]
        assert merge_short(list(units), rank) == merge_long(list(units), rank) == plain
