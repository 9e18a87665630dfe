"""Each operator on small fixtures: nulls, empty and repeated rows, ties, clashing column names, empty tables; brute force beside it."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from tokenloom.llm import exact_dedup, hidden_markov, mixing, ngram_join, pieces, quality_rules, repeats, tokens, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n int, kept boolean, rank int"


def fixture():
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "the", "of", "and", "Ärger", "niño", "idiot", "x1", "£5"]
    base = [" ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(rng.randrange(20, 120))) for _ in range(12)]
    texts = [None, "", " \t\n", "one", "Two  words", "a a a a a a", base[0], base[0], base[0] + " ", base[1].replace(" ", "\n", 3)]
    for t in base:
        w = t.split()
        texts += [t, " ".join(w[:-1] + ["changed"]), " ".join(w[: len(w) // 2] + base[2].split()[:30]), t.upper()]
    texts += ["longword" * 3000, "tick tock " * 400, "é" * 500, "<|endoftext|> in a text  <|endoftext|>", "tail   \n\n x"]
    rows = [(i, t, "en", ["a", "b", "c", None][i % 4 if i > 6 else 0], len(t or ""), "k", 1, True, 2) for i, t in enumerate(texts)]
    return rows + [rows[9], rows[9], (None, "no id", None, None, None, None, None, None, None), (None, base[3], "en", "a", 1, "k", 1, True, 2)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return [r.asDict() for r in df.collect()]


def words(t):
    return WORD.findall(t or "")


def test_empty_tables(empty):
    labels = empty.select("doc_id").selectExpr("doc_id", "1 as toxic")
    for df in (mixing.mixed(empty), exact_dedup.exact_groups(empty), ngram_join.joined(empty), quality_rules.judged(empty), hidden_markov.scored(empty, rounds=1), repeats.repeats(empty), tokens.token_counts(empty, JSON), tokens.id_digests(empty, JSON), pieces.round_trips(empty, MODEL), toxicity.scored(empty, labels)):
        assert df.collect() == []


def test_exact_dedup(docs):
    for hot in (2, 1000):
        got = rows(exact_dedup.exact_groups(docs, hot=hot))
        groups = collections.defaultdict(list)
        for r in fixture():
            groups[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")].append(r)
        want = collections.Counter()
        for norm, g in groups.items():
            g.sort(key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
            for i, r in enumerate(g):
                want[(r[0], g[0][0], len(g), i == 0, hashlib.sha256(norm.encode()).hexdigest())] += 1
        assert collections.Counter(tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in got) == want
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_mixing(docs, spark):
    got = rows(mixing.mixed(docs))
    assert len(got) == len(fixture())
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in got) == sorted((r[0] is None, r[0] or 0, len(words(r[1]))) for r in fixture())
    total = sum(len(words(r[1])) for r in fixture())
    assert sum({r["source_size"]: r["target"] for r in got}.values()) == pytest.approx(1.5 * total)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert sorted(map(str, got)) == sorted(map(str, rows(mixing.mixed(docs.repartition(5)))))
    many = spark.createDataFrame([(i, "w " * (1 + i * 7919 % 90), f"s{i % 3}") for i in range(900)], "doc_id long, text string, source string")
    by = collections.defaultdict(int)
    target = {}
    for r in rows(mixing.mixed(many)):
        s = f"s{r['doc_id'] % 3}"
        by[s] += r["taken"]
        target[s] = (r["target"], r["source_size"])
    sizes = {s: x[1] for s, x in target.items()}
    weight, budget, capped = {"s0": 3, "s1": 1, "s2": 2}, 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in capped]
        level = (budget - sum(capped.values())) / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > 2 * sizes[s]]
        if not over:
            break
        capped |= {s: 2 * sizes[s] for s in over}
    for s in sizes:
        assert target[s][0] == pytest.approx(capped.get(s, weight[s] * level))
        assert by[s] == pytest.approx(target[s][0], rel=0.005)


def brute_components(k, num, den):
    sets = {}
    for r in fixture():
        w = words((r[1] or "").translate(LOWER))
        n = min(k, len(w))
        sets.setdefault(r[0], set()).add(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset())
    flat = [(i, s) for i, g in sets.items() for s in g]
    label = list(range(len(flat)))
    changed = True
    while changed:
        changed = False
        for a in range(len(flat)):
            for b in range(a):
                x, y = flat[a][1], flat[b][1]
                if x and y and den * len(x & y) >= num * len(x | y) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    least = {}
    for (i, s), c in zip(flat, label, strict=True):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    return {(i, len(s), least.get(c) if s else i) for (i, s), c in zip(flat, label, strict=True)}


@pytest.mark.parametrize(("k", "t", "num", "den"), [(3, "0.9", 9, 10), (5, "0.8", 4, 5)])
def test_ngram_join(docs, k, t, num, den):
    got = rows(ngram_join.joined(docs, k=k, threshold=t))
    assert len(got) == len(fixture())
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == brute_components(k, num, den)


def test_near_copies_split_blocks(spark, monkeypatch):
    """A dense group whose links don't all meet in one hub, dealt over blocks."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for i in range(120):
        w = list(base)
        for j in rng.sample(range(80), rng.choice([0, 1, 2, 3])):
            w[j] = f"e{rng.randrange(9)}"
        texts.append((i, " ".join(w)))
    monkeypatch.setattr(ngram_join, "CELL", 16)
    got = {r["doc_id"]: r["component_id"] for r in rows(ngram_join.joined(spark.createDataFrame(texts, "doc_id long, text string"), k=3, threshold="0.9"))}
    sets = [set(zip(t.split(), t.split()[1:], t.split()[2:], strict=False)) for _, t in texts]
    label = list(range(len(sets)))
    for _ in sets:
        for a in range(len(sets)):
            for b in range(a):
                if 10 * len(sets[a] & sets[b]) >= 9 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert [got[i] for i in range(len(sets))] == label


def test_near_copies_with_repeated_and_null_ids(spark):
    text = lambda x, last="end": " ".join([*(f"{x}{i}" for i in range(60)), last])
    given = [(5, text("a")), (5, text("b")), (3, text("b", "other")), (9, text("a", "other")), (7, text("d")), (7, text("d", "other"))]
    given += [(None, text("c", f"c{i}")) for i in range(4)] + [(None, text("e")), (8, text("e", "other")), (None, ""), (None, None), (4, text("f"))]
    df = spark.createDataFrame([(*r, 1) for r in given], "doc_id long, text string, kept int")
    out = ngram_join.drop_near_copies(df)
    assert out.columns == df.columns
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert collections.Counter(t[0] if t else t for _, t in got) == collections.Counter(["a", "b", "c", "d", "e", "f", "", None])
    assert set(got) <= set(given) and {(5, text("a")), (3, text("b", "other")), (8, text("e", "other")), (4, text("f"))} <= set(got)
    again = ngram_join.drop_near_copies(df.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(str((r["doc_id"], r["text"])) for r in again)


def test_quality(docs):
    got = rows(quality_rules.judged(docs, columns=["doc_id", "text"]))
    assert len(got) == len(fixture())
    for r in got:
        t, q = r["row"]["c1"] or "", r["q"]
        w = words(t)
        windows = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in t.split("\n") if words(x)]
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(again) > 50 * len(w))
        assert not (r["kept"] and r["base_failed"])


def test_token_counts_and_files(docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(JSON)
    encode = lambda t: lib.encode(t or "", add_special_tokens=False).ids
    got = rows(tokens.token_counts(docs, JSON))
    assert sorted((r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == sorted((len((r[1] or "").encode()), n := len(encode(r[1])), n > 1024) for r in fixture())
    for bits in (False, True):
        got = sorted(rows(tokens.id_digests(docs, JSON, bits=bits)), key=lambda r: r["start"])
        assert [r["doc_id"] for r in got] == sorted((r[0] for r in fixture()), key=lambda x: (x is not None, x))
        at = 0
        for r in got:
            assert r["start"] == at
            at += r["n_tokens"]
        want = collections.Counter(zlib.crc32(np.array([*encode(r[1]), 0], "<u4").tobytes()) for r in fixture())
        assert collections.Counter(r["ids_crc32"] for r in got) == want


def test_pieces_against_brute_force(docs):
    rng = random.Random(1)
    vocab = [(i, p, -rng.random() * 9) for i, p in enumerate(["▁", "a", "b", "c", "ab", "abc", "▁a", "bc", "ca", "▁abc", "aa"])]
    seg = pieces.Segmenter(vocab, {}, 99)
    score = {p: s for _, p, s in vocab}
    for _ in range(200):
        text = "".join(rng.choice("abc d") for _ in range(rng.randrange(1, 12)))
        marked = seg.marked(text)
        best = [0.0] + [-math.inf] * len(marked)
        for e in range(1, len(marked) + 1):
            for s in range(e):
                best[e] = max(best[e], best[s] + score.get(marked[s:e], -math.inf))
            if marked[e - 1] not in score:
                best[e] = max(best[e], best[e - 1] + seg.cost)
        ids = seg.encode(text)
        assert sum(seg.cost if i == 99 else vocab[i][2] for i in ids) == pytest.approx(best[-1])
    assert all(r["same"] for r in rows(pieces.round_trips(docs, MODEL)))
    both = pieces.decoded(pieces.encoded(docs, MODEL, back="back"), MODEL)
    assert both.columns[: len(docs.columns)] == docs.columns
    assert all(bytes(r["back"]) == bytes(r["decoded"]) == (r["text"] or "").encode() for r in rows(both))


def test_pieces_against_library(docs):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = rows(pieces.encoded(docs, MODEL))
    assert len(got) == len(fixture()) and all(r["piece_ids"] == lib.encode(r["text"] or "") for r in got)
    seg, rng = pieces.segmenter(MODEL), random.Random(4)
    for _ in range(2000):
        text = "".join(rng.choice("aeinorst  ABé日😀1.,\n\t▁") for _ in range(rng.randrange(40)))
        assert seg.encode(text) == lib.encode(text)


def test_toxicity(docs, spark):
    rng = random.Random(2)
    make = lambda bad: " ".join(rng.choice(["du", "the", "sun", "rain", "you", "walk", "tree"]) if not bad or rng.random() > 0.2 else rng.choice(["idiot", "M0R0N!", "idi0t"]) for _ in range(40))
    train = [(i, make(i % 3 == 0), int(i % 3 == 0)) for i in range(900)]
    df = spark.createDataFrame(train, "doc_id long, text string, toxic int")
    got = {r["doc_id"]: r for r in rows(toxicity.scored(df.drop("toxic"), df.select("doc_id", "toxic")))}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for i, r in got.items())
    assert sum(got[i]["predicted"] == y for i, _, y in train if got[i]["held_out"]) >= 0.95 * sum(r["held_out"] for r in got.values())
    assert len(rows(toxicity.scored(docs, df.select("doc_id", "toxic")))) == len(fixture())


@pytest.mark.parametrize("size", [1, 1 << 17])
def test_toxicity_join_is_exact(docs, spark, monkeypatch, size):
    """A full filter lets every text through, and the join drops those without a label; repeated ids keep all their texts."""
    monkeypatch.setattr(toxicity, "FILTER_WORDS", size)
    labels = spark.createDataFrame([(i, i % 2) for i in [*range(0, 400, 3), 9]] + [(None, 1)], "doc_id long, label int").groupBy("doc_id").agg({"label": "max"}).toDF("doc_id", "label")
    got = toxicity.with_labels(docs.select("doc_id", "text"), labels)
    assert sorted(map(str, got.collect())) == sorted(map(str, docs.select("doc_id", "text").join(labels, "doc_id").collect()))
    assert toxicity.with_labels(docs.select("doc_id", "text"), labels.where("false")).collect() == []


def test_hidden_markov(docs):
    got = rows(hidden_markov.scored(docs, rounds=2, classes=8))
    assert len(got) == len(fixture())
    text = {r[0]: r[1] for r in fixture()}
    train = collections.Counter()
    for r in fixture():
        if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 != 1:
            train.update([*words((r[1] or "").translate(LOWER)), "\n"])
    total, distinct = sum(train.values()), len(train)
    for r in got:
        if r["doc_id"] is None:
            continue
        w = [*words((text[r["doc_id"]] or "").translate(LOWER)), "\n"]
        base = sum(math.log10((train[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in w)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(train[x] > 0 for x in w), total)
        assert r["base_score"] == pytest.approx(base)
        assert r["score"] < 0


def test_forward_against_all_paths():
    import itertools

    rng = np.random.default_rng(0)
    model = {"start": np.array([0.6, 0.4]), "move": np.array([[0.7, 0.3], [0.2, 0.8]]), "emit": rng.dirichlet(np.ones(3), 2).T}
    seqs = [np.array(x) for x in ([0, 2, 1, 1], [1], [2, 2, 0])]
    for x, got in zip(seqs, hidden_markov.log_likelihoods(model, seqs), strict=True):
        p = sum(model["start"][s[0]] * math.prod(model["move"][a, b] for a, b in zip(s, s[1:], strict=False)) * math.prod(model["emit"][o, k] for o, k in zip(x, s, strict=True)) for s in itertools.product(range(2), repeat=len(x)))
        assert got == pytest.approx(math.log10(p))
    counts = hidden_markov.expected(model, seqs)
    assert counts["start"].sum() == pytest.approx(3) and counts["emit"].sum() == pytest.approx(8) and counts["move"].sum() == pytest.approx(5)


@pytest.mark.parametrize("spread", [1, 2048])
def test_repeats(docs, monkeypatch, spread):
    monkeypatch.setattr(repeats, "SPREAD", spread)
    seen = collections.Counter()
    raws = [(r[0], (r[1] or "").encode()) for r in fixture()]
    for _, b in raws:
        seen.update(b[i : i + 200] for i in range(len(b) - 199))
    want = collections.Counter()
    for i, b in raws:
        gone = [False] * len(b)
        for s in range(len(b) - 199):
            if seen[b[s : s + 200]] > 1:
                gone[s : s + 200] = [True] * 200
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        want[(i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())] += 1
    got = collections.Counter(tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in rows(repeats.repeats(docs)))
    assert got == want
