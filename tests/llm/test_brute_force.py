"""Models against plain loops: mixing, quality, trees, isotonic map, features, hidden Markov scores; ids of any type; long texts."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tokenloom.llm import common, hidden_markov, mixing, pieces, quality_rules, textscan, tokens, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_mixing_against_bisection(spark):
    rng = random.Random(5)
    size = {i: rng.choice([0, 1, 3, 40, 90, 2000]) + rng.randrange(30) * (i % 3 > 0) for i in range(700)}
    of = {i: ["a", "b", "c", None, "lone"][i % 4 if i else 4] for i in size}
    df = spark.createDataFrame([(i, " ".join(["w"] * n), of[i]) for i, n in size.items()], "doc_id long, text string, source string").repartition(7)
    got = {r["doc_id"]: r for r in rows(mixing.mixed(df))}
    for s in {*of.values()}:
        mine = [i for i in size if of[i] == s]
        target, words = got[mine[0]]["target"], sum(size[i] for i in mine)
        assert all(got[i]["source_size"] == words and got[i]["target"] == target for i in mine)
        if target >= 2 * words:
            assert all(got[i]["taken"] == 2 * size[i] for i in mine)
            continue
        scale = max(1.0, words / max(1, sum(size[i] > 0 for i in mine)))
        total = lambda m: sum(size[i] * min(2.0, math.exp(min(50.0, m * size[i] / scale))) for i in mine)  # noqa: B023, E731
        low, high = -1e6, 1e6
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if total(mid) <= target else (low, mid)
        for i in mine:
            assert got[i]["rate"] == pytest.approx(min(2.0, math.exp(min(50.0, low * size[i] / scale))), rel=1e-3)
            assert got[i]["taken"] == size[i] * got[i]["copies"] and abs(got[i]["copies"] - got[i]["rate"]) < 2
        assert abs(sum(got[i]["taken"] for i in mine) - target) <= max(size[i] for i in mine)
        # Within a size, copies differ by one at most, and their number is the whole or the next of the rates' sum, but for what fills up.
        for z in {size[i] for i in mine}:
            assert len({got[i]["copies"] for i in mine if size[i] == z}) <= 2


def test_many_sources_are_ranked_in_order(spark):
    names = [f"s{i:04}" for i in range(900)] + [None]
    df = spark.createDataFrame([(i, "w " * (1 + i % 7), s) for i, s in enumerate(names)], "doc_id long, text string, source string").repartition(5)
    got = {r["doc_id"]: r for r in rows(mixing.mixed(df))}
    weight = [[3.0, 1.0, 2.0][i % 3] for i in range(901)]
    assert sum(r["target"] for r in got.values()) == pytest.approx(1.5 * sum(1 + i % 7 for i in range(901)))
    levels = {round(got[i]["target"] / weight[i], 9) for i in got if got[i]["target"] < 2 * got[i]["source_size"]}
    assert len(levels) == 1 and all(got[i]["source_size"] * 2 <= weight[i] * next(iter(levels)) + 1e-6 for i in got if got[i]["target"] == 2 * got[i]["source_size"])


def test_running_sums(spark):
    df = spark.createDataFrame([(i * 37 % 101, i) for i in range(101)], "k int, v int").repartition(6)
    got = common.before_each(df, [common.F.col("k")], {"before": common.F.col("v")}, common.Scratch(spark, "t"), "t").collect()
    assert all(r["before"] == sum(x["v"] for x in got if x["k"] < r["k"]) for r in got) and len(got) == 101


def test_quality_against_plain_estimation(spark):
    rng = random.Random(1)
    names = ["a", "b", "c"]
    patterns = collections.Counter()
    for _ in range(4000):
        good = rng.random() < 0.8
        patterns[tuple(0 if rng.random() < 0.1 else (-1 if rng.random() < (0.03 if good else p) else 1) for p in (0.9, 0.7, 0.8))] += 1
    model = quality_rules.fit(patterns, names)
    assert model["converged"] and abs(model["good"] - 0.8) < 0.03
    for x, p in zip(names, (0.9, 0.7, 0.8), strict=True):
        assert abs(model["votes"][x]["good"] - 0.03) < 0.02 and abs(model["votes"][x]["bad"] - p) < 0.06
    # One more round of plain estimation leaves the model as it is.
    docs = [r for r, n in patterns.items() for _ in range(n)]

    def chance(r, side):
        p = model["good"] if side == "good" else 1 - model["good"]
        for x, v in zip(names, r, strict=True):
            p *= 1 if not v else model["votes"][x][side] if v < 0 else 1 - model["votes"][x][side]
        return p

    post = [chance(r, "good") / (chance(r, "good") + chance(r, "bad")) for r in docs]
    assert (sum(post) + 1) / (len(docs) + 2) == pytest.approx(model["good"], abs=1e-3)
    for j, x in enumerate(names):
        down, up = (sum(p for p, r in zip(post, docs, strict=True) if r[j] == v) for v in (-1, 1))
        assert (down + 0.5) / (down + up + 1 + 0.1 * len(docs)) == pytest.approx(model["votes"][x]["good"], abs=1e-3)
    text = lambda i, bad: " ".join(("#$%&" if bad and k % 3 == 0 else "") + chr(97 + i % 26) + "ord" + chr(97 + k % 26) + chr(97 + k // 26) for k in range(90))
    df = spark.createDataFrame([(i, text(i, i % 5 == 0)) for i in range(200)] + [(500, None), (501, "a b " * 40)], "doc_id long, text string")
    got = {r["row"]["c0"]: r for r in rows(quality_rules.judged(df))}
    assert all(got[i]["kept"] == (i % 5 > 0) for i in range(200)) and not got[500]["kept"] and got[501]["base_failed"]
    votes = rows(quality_rules.judged(df).where("not base_failed").select("quality", *[c.alias(n) for n, c in quality_rules.rules().items()]))
    fitted = quality_rules.fit(collections.Counter(tuple(r[n] for n in quality_rules.rules()) for r in votes), list(quality_rules.rules()))
    for r in votes[::20]:
        odds = math.log(fitted["good"] / (1 - fitted["good"]))
        for n, p in fitted["votes"].items():
            odds += {-1: math.log(p["good"] / p["bad"]), 0: 0.0, 1: math.log((1 - p["good"]) / (1 - p["bad"]))}[r[n]]
        assert r["quality"] == pytest.approx(1 / (1 + math.exp(-odds)))


def test_trees_against_plain_loops():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 6, (300, 3)).astype(float)
    y = ((x[:, 0] > 2) & (x[:, 1] < 4) ^ (rng.random(300) < 0.1)).astype(float)
    model = toxicity.fit_trees(x, y, trees=3, depth=2, rate=0.5)
    margin = [model["prior"]] * len(y)
    for feature, cut, value in model["trees"]:
        p = [1 / (1 + math.exp(-m)) for m in margin]
        g, h = [a - b for a, b in zip(p, y, strict=True)], [max(a * (1 - a), 1e-6) for a in p]
        node = [0] * len(y)
        bins = [[sum(c < v for c in model["cuts"][j]) for v in x[:, j]] for j in range(3)]
        for level in range(2):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                inside = [i for i in range(len(y)) if node[i] == k]
                best = 0.0
                for j in range(3):
                    for c in range(len(model["cuts"][j]) + 1):
                        left = [i for i in inside if bins[j][i] <= c]
                        right = [i for i in inside if bins[j][i] > c]
                        if min(len(left), len(right)) >= toxicity.LEAST:
                            s = lambda ids: sum(g[i] for i in ids) ** 2 / (sum(h[i] for i in ids) + 1)  # noqa: B023, E731
                            best = max(best, s(left) + s(right) - s(inside))
                left, right = ([i for i in inside if (bins[feature[k]][i] > cut[k]) == side] for side in (False, True))
                if best > 1e-9:
                    assert s(left) + s(right) - s(inside) == pytest.approx(best)
                for i in inside:
                    node[i] = 2 * k + 1 + (bins[feature[k]][i] > cut[k])
        for leaf in range(4):
            inside = [i for i in range(len(y)) if node[i] == leaf + 3]
            assert value[leaf] == pytest.approx(-0.5 * sum(g[i] for i in inside) / (sum(h[i] for i in inside) + 1))
            for i in inside:
                margin[i] += value[leaf]
    assert toxicity.margins(model, x) == pytest.approx(np.array(margin))


def test_isotonic_against_min_max():
    rng = np.random.default_rng(4)
    m, y = rng.permutation(60).astype(float), (rng.random(60) < 0.4).astype(float)
    at, value = toxicity.isotonic(m, y)
    s = y[np.argsort(m)]
    fit = [max(min(s[a:b].mean() for b in range(i + 1, 61)) for a in range(i + 1)) for i in range(60)]
    want = [(len(list(g)), v) for v, g in itertools.groupby(np.round(fit, 12))]
    assert len(at) == len(want) and (np.diff(at) > 0).all()
    assert value == pytest.approx([(v * n + y.mean()) / (n + 1) for n, v in want])


def test_features_against_plain_loops():
    bad = toxicity.hashes_of(("idiot",))
    text = "You IDIOT! are an idi0t, sure; the 1diot walks HOME 42 x"
    x = dict(zip(toxicity.NAMES, toxicity.features(pa.array([text, None, ""]), np.sort(bad), np.zeros(0, np.uint64))[0], strict=True))
    words = text.split()
    assert x["words"] == pytest.approx(math.log1p(len(words)))
    assert x["strong"] == pytest.approx(3 / len(words)) and x["strong_count"] == 3 and x["disguised"] == pytest.approx(2 / len(words))
    assert x["strong_plain"] == pytest.approx(1 / len(words)) and x["second_person"] == pytest.approx(1 / len(words)) and x["near"] == pytest.approx(2 / len(words))
    letters = sum(c.isalpha() for c in text)
    assert x["capitals"] == pytest.approx(sum(c.isupper() for c in text) / letters) and x["marks"] == pytest.approx(1 / len(words))
    assert x["shouted"] == pytest.approx(2 / len(words)) and x["digits"] == pytest.approx(sum(c.isdigit() for c in text) / len(words))
    assert not toxicity.features(pa.array([None, ""], pa.string()), bad, bad).any()


def test_labels_of_one_class(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(40)] + [(1, "again"), (None, "none")], "doc_id long, text string")
    for value in (0, 1):
        got = rows(toxicity.scored(df, spark.createDataFrame([(i, value) for i in range(40)] + [(3, None)], "doc_id long, toxic int")))
        assert len(got) == 42 and {r["score"] for r in got} == {float(value)}


def test_expected_counts_against_all_paths():
    rng = np.random.default_rng(0)
    model = {"start": np.array([0.6, 0.4]), "move": np.array([[0.7, 0.3], [0.2, 0.8]]), "emit": rng.dirichlet(np.ones(3), 2).T}
    seqs = [np.array(x) for x in ([0, 2, 1, 1, 0, 2, 2], [1], [2, 2, 0, 1])]
    want = {"start": np.zeros(2), "move": np.zeros((2, 2)), "emit": np.zeros((3, 2)), "log": 0.0}
    for x in seqs:
        paths = list(itertools.product(range(2), repeat=len(x)))
        p = [model["start"][s[0]] * math.prod(model["move"][a, b] for a, b in itertools.pairwise(s)) * math.prod(model["emit"][o, k] for o, k in zip(x, s, strict=True)) for s in paths]
        want["log"] += math.log10(sum(p))
        for s, q in zip(paths, p, strict=True):
            q /= sum(p)
            want["start"][s[0]] += q
            for a, b in itertools.pairwise(s):
                want["move"][a, b] += q
            for o, k in zip(x, s, strict=True):
                want["emit"][o, k] += q
    for segment in (1, 2, 3, 100):
        got = hidden_markov.expected(model, seqs, segment)
        for name, value in want.items():
            assert got[name] == pytest.approx(value)


def test_classes_beyond_sixteen_bits():
    words, suffixes, _ = hidden_markov.tokens(pa.array([" ".join(f"w{i}" for i in range(80_000))]))
    v = hidden_markov.Vocabulary([(int(w), 1) for w in words[:70_000].view(np.int64)], {}, 70_000, 70_000, 1)
    got = v.classes(words, suffixes)
    assert (v.words[got[:70_000]] == words[:70_000]).all()
    assert (got[70_000:] == 70_000 + suffixes[70_000:].astype(int)).all()


@pytest.mark.parametrize(("held", "size"), [(3, 1), (40, 300), (1 << 20, 1 << 24)])
def test_word_counts_and_encoding_against_loops(monkeypatch, held, size):
    rng = random.Random(5)
    texts = [None if i % 17 == 0 else " ".join(rng.choice(("The", "cat", "a", "é", "日本", f"w{rng.randrange(40)}")) for _ in range(rng.randrange(9))) for i in range(2300)]
    texts += ["", " \n "]
    monkeypatch.setattr(hidden_markov, "HELD_WORDS", held)
    monkeypatch.setattr(hidden_markov, "CUT_BYTES", size)
    lower = [WORD.findall((t or "").lower()) for t in texts]
    want = collections.Counter(w for t in lower for w in t)
    column = pa.array(texts, pa.string())
    parts = [pa.RecordBatch.from_arrays([column.slice(a, 1100)], ["text"]) for a in range(0, len(texts), 1100)]
    names = {w: int(hidden_markov.tokens(pa.array([w]))[0].view(np.int64)[0]) for w in want}
    got = collections.Counter()
    for batch in hidden_markov.count_words(iter(parts)):
        for w, n in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            got[w] += n
    assert got == {names[w]: n for w, n in want.items()}
    assert all(names[w] % hidden_markov.SUFFIXES == hidden_markov.tokens(pa.array([w]))[1][0] for w in want)

    own = [w for w, _ in want.most_common(6)]
    v = hidden_markov.Vocabulary([(names[w], want[w]) for w in own], {}, sum(want.values()), len(want), len(texts))
    monkeypatch.setattr("pyspark.TaskContext.get", staticmethod(lambda: type("Task", (), {"partitionId": lambda self: 1})()))
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([False] * len(texts)), column], ["doc_id", "held_out", "text"])
    encoded = [r for b in hidden_markov.encoder(v)(iter([rows.slice(0, 1500), rows.slice(1500)])) for r in b.to_pylist()]
    assert [r["row"] for r in encoded] == [(1 << 40) + i for i in range(len(texts))]
    of = {int(w): i for i, w in enumerate(v.words.view(np.int64))}
    for r, words in zip(encoded, lower, strict=True):
        classes = [of.get(names[w], v.k + names[w] % hidden_markov.SUFFIXES) for w in words]
        assert np.frombuffer(r["sequence"], "<u4").tolist() == [*classes, v.size - 1]
        assert r["n_tokens"] == len(words) + 1
        assert dict(zip(r["words"], r["counts"], strict=True)) == collections.Counter(names[w] for w in words if w not in own)
        assert r["top_known"] == sum(w in own for w in words) + 1
        assert r["top_base"] == pytest.approx(sum(v.base_log[of[names[w]]] for w in words if w in own) + v.base_log[-1])


def test_short_numbers_give_the_counts_of_long_ones():
    rng = np.random.default_rng(3)
    emit, move = rng.random((300, 8)) ** 6, rng.random((8, 8)) ** 4
    model = {"start": np.full(8, 1 / 8), "move": move / move.sum(1, keepdims=True), "emit": emit / emit.sum(0)}
    seqs = [rng.integers(0, 300, n) for n in [5000, *rng.integers(1, 60, 200)]]
    short = {name: np.asfortranarray(x).astype(np.float32) for name, x in model.items()}
    want, got = hidden_markov.expected(model, seqs), hidden_markov.expected(short, seqs, 777)
    for name in ("start", "move", "emit", "log"):
        assert got[name] == pytest.approx(want[name], rel=1e-4, abs=1e-4)


def test_scores_against_plain_recursion(spark):
    rng = random.Random(9)
    vocab = [f"{a}{b}" for a in "abcd" for b in ("ing", "er", "x", "ed")]
    texts = {i: " ".join(rng.choice(vocab[: 3 + i % 13]) for _ in range(rng.randrange(0, 30))) for i in range(60)}
    texts[60] = "Unseen WORDS only"
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in rows(hidden_markov.scored(df, rounds=0, classes=5, states=3))}
    lower = {i: WORD.findall(t.lower()) for i, t in texts.items()}
    learn = [i for i in texts if zlib.crc32(str(i).encode()) % 5 != 1]
    count = collections.Counter(w for i in learn for w in lower[i])
    hashed = {}
    for w in {w for t in lower.values() for w in t}:
        h, s, _ = hidden_markov.tokens(pa.array([w]))
        hashed[w] = int(h[0]), int(s[0])
    levels = collections.Counter(math.floor(16 * math.log2(n)) for n in count.values())
    own, kept = set(), 0
    for level in sorted(levels, reverse=True):
        kept += levels[level]
        if kept > 5:
            break
        own |= {w for w, n in count.items() if math.floor(16 * math.log2(n)) == level}
    mass = [sum(n + 0.5 for w, n in count.items() if w not in own and hashed[w][1] == k) for k in range(hidden_markov.SUFFIXES)]
    v = hidden_markov.Vocabulary([(int(np.uint64(hashed[w][0]).view(np.int64)), count[w]) for w in own], dict(enumerate(mass)), sum(count.values()), len(count), len(learn))
    model = hidden_markov.start_model(v, 3)
    for i, words in lower.items():
        total, a = 0.0, None
        for w in [*words, None]:
            if w is None:
                k = v.size - 1
            else:
                k = int(v.classes(np.array([hashed[w][0]], np.uint64), np.array([hashed[w][1]]))[0])
            a = [(model["start"][s] if a is None else sum(a[r] * model["move"][r][s] for r in range(3))) * model["emit"][k][s] for s in range(3)]
            if w is not None and w not in own:
                total += math.log10((count[w] + 0.5) / (mass[hashed[w][1]] + 0.5))
        assert got[i]["score"] == pytest.approx(total + math.log10(sum(a)))
    better = rows(hidden_markov.scored(df, classes=5, states=3))
    assert sum(r["score"] for r in better if not r["held_out"]) > sum(r["score"] for r in got.values() if not r["held_out"])


def odd_texts():
    rng = random.Random(8)
    units = ["the", " word", " ", "  ", "\n", " ", "　", "don't", "é", "日本", "<|endoftext|>", "\x1c", "X9", "1234", "!?", "​"]
    return ["".join(rng.choice(units) for _ in range(rng.randrange(1, 400))) for _ in range(60)]


def test_counts_and_files_by_id(spark):
    """Odd and long texts, one of 5 MB, each compared under its own id; ids are text."""
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(JSON)
    texts = {f"id{i:03}": t for i, t in enumerate([*odd_texts(), "plain words and more " * 240_000, ("odd one " * 9 + "and some words ") * 3000, "", "x" * 60_000])}
    df = spark.createDataFrame([*texts.items(), (None, "no id")], "doc_id string, text string").repartition(3)
    ids = {k: lib.encode(t, add_special_tokens=False).ids for k, t in texts.items()}
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in rows(tokens.token_counts(df, JSON)) if r["doc_id"]} == {k: (len(t.encode()), len(ids[k])) for k, t in texts.items()}
    got = {r["doc_id"]: r for r in rows(tokens.id_digests(df, JSON))}
    start = got[None]["n_tokens"]
    for k in sorted(texts):
        want = np.array([*ids[k], 0], "<u4")
        assert (got[k]["start"], got[k]["n_tokens"], got[k]["ids_crc32"]) == (start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)


def test_library_cuts(monkeypatch):
    monkeypatch.setattr(tokens, "CUT_CHARS", 8)
    lib = tokens.library(JSON)
    for t in odd_texts():
        assert "".join(lib.parts(t)) == t
        assert np.frombuffer(lib.packed([t])[0], lib.type).tolist() == lib.encode([t])[0]


def test_pieces_query_against_library(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {i: t for i, t in enumerate([*odd_texts(), "", "words " * 200_000])}
    df = spark.createDataFrame([*texts.items(), (None, None)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in rows(pieces.round_trips(df, MODEL))}
    for i, t in texts.items():
        ids = np.array(lib.encode(t), "<i4")
        assert (got[i]["n_pieces"], got[i]["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes())) and got[i]["same"]
    assert got[None]["n_pieces"] == 0


def test_batches_by_bytes():
    column = pa.array(["日" * 100, None, "a" * 100, "b" * 500, "", "c"])
    parts = list(tokens.balanced(column, 320))
    assert [first for first, _ in parts] == [0, 2, 3, 4] and sum((x for _, x in parts), []) == ["日" * 100, "", "a" * 100, "b" * 500, "", "c"]
    assert textscan.text_bytes(column)[1].tolist() == [0, 300, 300, 400, 900, 900, 901]


def test_clusters_need_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        class _jsc:  # noqa: N801
            @staticmethod
            def sc():
                class C:
                    @staticmethod
                    def getCheckpointDir():  # noqa: N802
                        class O:  # noqa: E742
                            isDefined = staticmethod(lambda: False)  # noqa: N815

                        return O

                return C

    class Session:
        sparkContext = Context  # noqa: N815

        class conf:  # noqa: N801
            get = staticmethod(lambda *a: None)

    with pytest.raises(ValueError, match="share"):
        common.shared_folder(Session)
