"""Operators on texts against brute force, the public libraries, and odd inputs."""

import base64
import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest

from nocturne.llm import bytebpe, linededup, lm, lpf, minhash, mixing, text, tokencount, toxicity
from nocturne.llm.components import connected_components
from nocturne.llm.scratch import Scratch

WORD = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " \n\t", "one", "it's 'S 're  x\r\n", "é'll ñ　中 ½ 12 345", "<|endoftext|> a<|startoftext|>b", "a" * 5000, "😀 ́x \x85 \x00", "Ａ İ Σ ΑΣ"]


def documents(spark, texts, **extra):
    """With extra columns whose names clash with the operators' own."""
    rows = [(i, t, f"s{i % 2}" if i % 5 else None, "en" if i % 3 else None, -1, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_tokens int, score string")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def prose(seed, n, vocabulary=200):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def test_byte_bpe_equals_tiktoken(spark):
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice(["'", "s", "ve", "ll", " ", "\n", "　", "é", "1", "!", "😀", "The"]) for _ in range(30)) for _ in range(200)]
    docs = documents(spark, texts)
    got = {r.doc_id: r for r in bytebpe.digests(docs).collect()}
    coded = bytebpe.encode(docs)
    for r in coded.collect():
        text = texts[r.doc_id] or ""
        ids = library.encode_ordinary(text)
        assert list(r.ids) == ids
        at, chars = 0, []
        for i in ids:
            chars.append(len(text.encode()[:at].decode(errors="ignore")))
            at += len(library.decode_single_token_bytes(i))
        assert list(r.starts) == chars
        d = got[r.doc_id]
        assert (d.n_tokens, d.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert d.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert {r.doc_id: r.text for r in bytebpe.decode(coded).collect()} == {i: t or "" for i, t in enumerate(texts)}


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice(["'", "s", "Re", "ve", "l", " ", "\n", "é", "é", "1", "!", "😀", "the", "<|endoftext|>"]) for _ in range(40)) for _ in range(200)]
    for r in tokencount.token_counts(documents(spark, texts), limit=30).collect():
        t = texts[r.doc_id] or ""
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 30), t


def test_token_counts_of_words_longer_than_a_chunk(spark, monkeypatch):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9000)), "theand" * 2000, "x" * 5001, "ab", "é" * 3000 + " " + "ing" * 1500, thue_morse(6000, "a", "b")]
    for long, warm in ((2048, 256), (100, 30), (64, 1)):  # with little warm-up, chunks are entered in other states
        monkeypatch.setattr(tokencount, "LONG", long)
        monkeypatch.setattr(tokencount, "WARM", warm)
        got = tokencount.count_texts(tokencount.counter(public_tokenizers.path("word_bpe_49k.json")), texts)
        assert got.tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def near_by_force(texts, k, percent):
    sets = [frozenset(tuple(w[i : i + min(k, len(w))]) for i in range(len(w) - min(k, len(w)) + 1)) if w else frozenset() for w in map(words, texts)]
    low = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and 100 * len(a & b) >= percent * len(a | b) and low[i] != low[j]:
                    low[i] = low[j] = min(low[i], low[j])
                    changed = True
    return sets, low


def test_near_duplicates(spark):
    texts = list(ODD) + ["One", "one", "ONE two", "one TWO"]
    for g in range(4):
        base = prose(g, 120).split()
        for c in range(8):
            rng = random.Random(100 * g + c)
            copy = list(base)
            for _ in range(c):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(999)}"
            texts.append(" ".join(copy))
    sets, low = near_by_force(texts, 3, 85)
    for r in minhash.near_duplicates(documents(spark, texts), 3, 85).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), low[r.doc_id], low[r.doc_id] == r.doc_id)
    assert minhash.near_duplicates(documents(spark, [])).count() == 0


def test_components(spark):
    links = [(1, 2), (3, 2), (5, 4), (4, 5), (6, 6), (8, 9), (9, 10), (10, 11), (11, 12), (12, 1)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "u long, v long"), Scratch(spark, "t")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 8: 1, 9: 1, 10: 1, 11: 1, 12: 1}


def test_repeats(spark, monkeypatch):
    shared, other = prose(1, 120), prose(2, 90)
    texts = [*ODD, shared + " end", "begin " + shared, other[:399], other[:399], other[:400], other[:400], prose(3, 300), other + other]
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(t[i : i + 400] for t in raw for i in range(len(t) - 399))
    for crowd in (2_000, 1):  # with 1 every anchor goes the way of crowds
        monkeypatch.setattr(lpf, "CROWD", crowd)
        for r in lpf.remove_repeats(documents(spark, texts)).collect():
            t = raw[r.doc_id]
            gone = np.zeros(len(t), bool)
            for i in range(len(t) - 399):
                if seen[t[i : i + 400]] > 1:
                    gone[i : i + 400] = True
            assert r.kept == bytes(b for b, g in zip(t, gone, strict=True) if not g)
            assert sum(x.hi - x.lo for x in r.removed) == gone.sum()


def test_lpf_by_force():
    rng = np.random.default_rng(0)
    for _ in range(40):
        d = rng.integers(97, 97 + rng.integers(1, 4), rng.integers(0, 60)).astype(np.uint8)
        depth, n = int(rng.integers(1, 30)), len(d)
        match = lambda i, j: next((x for x in range(depth + 1) if x == depth or i + x >= n or d[i + x] != d[j + x]), 0)  # noqa: B023, E731
        assert lpf.lpf(d, depth).tolist() == [max([match(i, j) for j in range(i)], default=0) for i in range(n)]


def test_lines(spark):
    texts = ["top\nbody %d\n\nfoot" % i for i in range(20)] + [None, "", "alone\nalone"]
    docs = documents(spark, texts)
    for r in linededup.drop_lines(docs, ratio=0.5, min_pages=5).collect():
        t = texts[r.doc_id]
        expected = t if r.source is None or t is None or not t.startswith("top") else t.replace("top\n", "").replace("\nfoot", "")
        assert r.text == expected and r.score == "clash"


def test_toxicity_holds_out(spark):
    rng = random.Random(5)
    texts, toxic = [], []
    for i in range(900):
        w = prose(i, 60).split()
        toxic.append(int(i % 6 == 0))
        if toxic[-1]:
            for _ in range(3):
                w[rng.randrange(60)] = rng.choice(["vile", "rotten", "filth"]) + rng.choice(["", ".", "!"])
        texts.append(" ".join(w))
    texts += [None, ""]
    labels = spark.createDataFrame([*enumerate(toxic), (0, None), (5000, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(documents(spark, texts), labels).collect()}
    held = [r for r in got.values() if r.held_out and r.doc_id < 900]
    assert len(got) == 902 and len(held) > 200
    assert np.mean([r.predicted == toxic[r.doc_id] for r in held]) > 0.97
    assert got[900].score == got[901].score


def naive_features(t):
    """Words, pairs and pairs one word apart of a text, as a set of names."""
    w = re.findall("[0-9A-Za-z\x80-\U0010ffff]+", t or "")
    w = [x.translate(LOW) for x in w]
    return {(x,) for x in w} | {(1, *p) for p in zip(w, w[1:])} | {(2, *p) for p in zip(w, w[2:])}


def test_toxicity_features_by_force():
    import pyarrow as pa

    texts = [*ODD, "A b c a b", "one. two! THREE, one", "b", None, "a b a b a b"]
    x, cut = toxicity.features(*text.utf8(pa.array(texts, pa.string())))
    sets = [set(x[i:j].tolist()) for i, j in zip(cut[:-1], cut[1:], strict=True)]
    names = {}
    for t, s in zip(texts, sets, strict=True):
        own = naive_features(t)
        assert len(s) == len(own)  # no two of these share a bucket
        for f in own:
            names.setdefault(f, set(s)).intersection_update(s)
    assert all(names.values())
    for t, s in zip(texts, sets, strict=True):  # what has a feature holds its bucket, and what has not does not
        for f, b in names.items():
            if len(b) == 1:
                assert (f in naive_features(t)) == (next(iter(b)) in s)


def test_toxicity_training_by_force():
    """FTRL-proximal, one coordinate at a time."""
    import pyarrow as pa

    rng = random.Random(3)
    texts = [" ".join(rng.choice(["vile", "good", "day", "rot", "tea"]) for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    toxic = np.array([int("vile" in t) for t in texts])
    w, bias = toxicity.train(pa.array(texts), toxic)
    x, cut = toxicity.features(*text.utf8(pa.array(texts)))
    seen = collections.Counter(x.tolist())
    z, n, zb, nb = collections.defaultdict(float), collections.defaultdict(float), 0.0, 0.0
    l1 = max(1.0, len(texts) * toxicity.L1_PER_DOCUMENT)
    weight = lambda i: 0.0 if abs(z[i]) <= l1 else -(z[i] - np.sign(z[i]) * l1) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)
    order = np.random.default_rng(7)
    for _ in range(toxicity.EPOCHS):
        for d in order.permutation(len(texts)):
            own = [i for i in x[cut[d] : cut[d + 1]].tolist() if seen[i] >= toxicity.LEAST_DOCUMENTS]
            b = -zb / ((toxicity.BETA + nb**0.5) / toxicity.ALPHA)
            g = 1 / (1 + np.exp(-(sum(map(weight, own)) + b))) - toxic[d]
            if abs(g) < toxicity.SETTLED:
                continue
            for i, wi in [(i, weight(i)) for i in own]:
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / toxicity.ALPHA * wi
                n[i] += g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / toxicity.ALPHA * b
            nb += g * g
    expected = np.zeros(toxicity.DIM)
    for i in z:
        expected[i] = weight(i)
    assert np.count_nonzero(expected) > 3 and np.allclose(w, expected) and bias == pytest.approx(-zb / ((toxicity.BETA + nb**0.5) / toxicity.ALPHA))


def test_mixing_meets_the_targets(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 3}", ("en", "fr")[i % 2], "x") for i in range(3000)] + [(9001, None, None, None, "x"), (9002, "", "s1", "en", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, prob string")
    out = mixing.mix(docs, {"source": None, "lang": {"en": 0.5, "fr": 0.5}, "topic": None}, rate=0.3, sweeps=8).collect()
    total = sum(r.tokens for r in out)
    source = {r[0]: r[2] for r in rows}
    for s in ("s0", "s1", "s2"):
        assert sum(r.tokens * r.prob for r in out if source[r.doc_id] == s) == pytest.approx(0.1 * total, rel=0.02)
    assert sum(r.kept for r in out) / len(out) == pytest.approx(0.3, abs=0.05)
    clash = docs.selectExpr("*", *(f"'x' AS {c}" for c in ("_p", "_topic", "_tokens", "_prob", "_kept", "_source", "_lang")))
    assert mixing.sample(clash).columns == clash.columns
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_tells_what_it_misses(spark):
    rows = [(i, "w " * 30, "s0", "en") for i in range(95)] + [(100 + i, "License " * 30, "s0", "en") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    targets = {"source": None, "lang": None, "topic": {"prose": 0.8, "licence": 0.2}}
    cut = {r.category: r for r in mixing.missed(docs, targets, meet=False).where("dimension = 'topic'").collect()}
    assert cut["licence"].goal == pytest.approx(0.2) and cut["licence"].residual < -0.05
    met = mixing.missed(docs, targets).collect()
    assert {r.dimension for r in met} == {"source", "lang", "topic"} and all(abs(r.residual) < 1e-6 for r in met)


def test_mixing_of_the_pipeline_meets_targets_that_the_rate_does_not_allow(spark):
    import corpus_pipeline

    rng = random.Random(8)
    kinds = ["w " * 30] * 94 + ["a | b " * 10] * 3 + ["License " * 30] * 3
    rows = [(i, rng.choice(kinds), f"s{i % 2}", rng.choice(["en", "en", "fr", "de", "es", "it"])) for i in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    kept = corpus_pipeline.mix_sources(spark, docs, "").collect()
    total = sum(len(words(r.text)) for r in kept)
    share = lambda of: sum(len(words(r.text)) for r in kept if of(r)) / total
    assert share(lambda r: " | " in r.text) == pytest.approx(0.1, abs=0.012)
    assert share(lambda r: "License" in r.text) == pytest.approx(0.1, abs=0.012)
    assert share(lambda r: r.lang == "en") == pytest.approx(0.55, abs=0.02)
    assert share(lambda r: r.source == "s0") == pytest.approx(0.5, abs=0.02)


def lm_model(seed):
    rng = np.random.default_rng(seed)
    pairs = rng.integers(0, 9, (lm.CLASSES, lm.CLASSES)).astype(float)
    p = lm.initial()
    p["o"] += rng.standard_normal(p["o"].shape).astype(np.float32)
    return rng, p, lm.pair_table(pairs), rng.integers(0, lm.GROUPS, lm.CLASSES)


def test_lm_gradient():
    rng, p, pair, group = lm_model(1)
    shares = lm.by_group(pair, group).astype(np.float64)
    p = {k: v.astype(np.float64) for k, v in p.items()}
    c = rng.integers(0, lm.CLASSES, (3, lm.CONTEXT + 1))
    c[1, 20:] = -1
    _, g = lm.gradient(p, shares, group, c)
    for k in g:
        i = tuple(rng.integers(0, s) for s in p[k].shape) if k != "emb" else (c[0, 3], 1)
        step = 1e-5
        up, down = ({**p, k: p[k].copy()} for _ in range(2))
        up[k][i] += step
        down[k][i] -= step
        slope = (lm.gradient(up, shares, group, c)[0] - lm.gradient(down, shares, group, c)[0]) / (2 * step)
        assert g[k][i] == pytest.approx(slope, rel=2e-2, abs=1e-6), k


def test_lm_gradient_without_its_loss():
    """Training asks for no loss: the same gradient, and no logarithms."""
    rng, p, pair, group = lm_model(3)
    c = rng.integers(0, lm.CLASSES, (5, lm.CONTEXT + 1))
    c[2, 7:] = -1
    (loss, g), (none, same) = (lm.gradient(p, lm.by_group(pair, group), group, c, measured=m) for m in (True, False))
    assert np.isfinite(loss) and np.isnan(none)
    assert g.keys() == same.keys() and all((g[k] == same[k]).all() for k in g)


def test_lm_scores_with_shares_at_hand():
    rng, p, pair, group = lm_model(4)
    x, y = rng.integers(0, lm.CLASSES, (2, 90))
    of = np.repeat([0, 1, 2], [20, 1, 69])
    expected = lm.class_scores(p, pair, group, x, y, of)
    assert (lm.class_scores(p, pair, group, x, y, of, lm.by_group(pair, group)) == expected).all()


def test_lm_scores_do_not_see_ahead_or_other_texts():
    rng, p, pair, group = lm_model(2)
    x = rng.integers(0, lm.CLASSES, 150)
    y = np.roll(x, -1)
    of = np.repeat([0, 1], [70, 80])
    whole = lm.class_scores(p, pair, group, x, y, of)
    assert lm.class_scores(p, pair, group, x[70:], y[70:], of[70:]) == pytest.approx(whole[70:], rel=1e-3)
    assert lm.class_scores(p, pair, group, x[:50], y[:50], of[:50]) == pytest.approx(whole[:50], rel=1e-3)
    one = np.array([lm.class_scores(p, pair, group, x[:31], np.append(y[:30], c), of[:31])[-1] for c in range(lm.CLASSES)])
    assert np.exp(one).sum() == pytest.approx(1, rel=1e-3)


def test_lm_baseline(spark):
    texts = [*ODD, *(prose(i, 80) for i in range(60))]
    train = "doc_id % 5 <> 1"
    counts = collections.Counter(w for i, t in enumerate(texts) if i % 5 != 1 for w in [*words(t), None])
    n, v = sum(counts.values()), len(counts)
    for r in lm.lm_scores(documents(spark, texts), train=__import__("pyspark.sql.functions", fromlist=["expr"]).expr(train)).collect():
        own = [*words(texts[r.doc_id]), None]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(np.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own))
        assert r.score < 0


def test_lm_stays_finite_far_below_zero():
    """Places whose products are all so low that the power of each is 0: the first of a text sees itself alone."""
    rng, p, pair, group = lm_model(8)
    for low in ("k", "out"):
        p[low] = -40 * np.abs(p[low])
    p["emb"], p["q"], p["v"], p["o"] = (3 * np.abs(p[w]) for w in ("emb", "q", "v", "o"))
    c = rng.integers(0, lm.CLASSES, (3, lm.CONTEXT + 1))
    _, g = lm.gradient(p, lm.by_group(pair, group), group, c)
    assert all(np.isfinite(x).all() for x in g.values())
    x = rng.integers(0, lm.CLASSES, 40)
    of = np.repeat([0, 1, 2], [1, 19, 20])
    assert np.isfinite(lm.class_scores(p, pair, group, x, np.roll(x, -1), of)).all()
    every = np.array([lm.class_scores(p, pair, group, x, np.full(40, y), of) for y in range(lm.CLASSES)])
    assert np.exp(every.astype(float)).sum(axis=0) == pytest.approx(np.ones(40), rel=1e-3)


def test_lm_windows_hold_every_training_id_once():
    import pyarrow as pa

    paths = lm.public_path(lm.RANKS), lm.public_path(lm.VOCABULARY)
    texts = [prose(1, 700), None, "", "one", prose(2, 31)]
    ids, size = lm.Slice(pa.array(texts, pa.string())).streams(paths)
    got = lm.windows_of(ids, size).tolist()
    assert all(len(w) == lm.CONTEXT + 1 for w in got)
    assert [i for w in got for i in w[1:] if i >= 0] == ids.tolist()
    whole = [lm.END, *ids.tolist()]
    at = 0
    for w in got:  # each begins with the id before
        assert w[0] == whole[at]
        at += sum(i >= 0 for i in w[1:])


def test_lm_scores_by_force():
    """One place after another, plain loops, no blocks: attention over the CONTEXT classes of the own text."""
    rng, p, pair, group = lm_model(6)
    size = [1, 50, 5, 90, 33]
    of = np.repeat(np.arange(len(size)), size)
    x, y = rng.integers(0, lm.CLASSES, (2, sum(size)))
    got = lm.class_scores(p, pair, group, x, y, of)
    for i in range(len(x)):
        j = np.array([j for j in range(max(0, i - lm.CONTEXT + 1), i + 1) if of[j] == of[i]])
        s = np.exp(np.array([p["emb"][x[i]] @ p["q"] @ (p["emb"][x[k]] @ p["k"]) / lm.WIDTH**0.5 + p["rel"][i - k] for k in j]))
        h = (s / s.sum()) @ (p["emb"][x[j]] @ p["v"]) @ p["o"]
        logits = pair[x[i]].astype(float) + (h @ p["out"])[group]
        assert got[i] == pytest.approx(logits[y[i]] - np.log(np.exp(logits).sum()), rel=1e-3, abs=1e-3)


def test_lm_does_not_depend_on_partitions(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(lm, "SHARD_BYTES", 4_000)  # several groups
    docs = documents(spark, [prose(i, 80) for i in range(120)] + ODD)
    train = F.col("doc_id") % 5 != 1
    one, many = ({r.doc_id: r for r in lm.lm_scores(docs.repartition(n), train).collect()} for n in (1, 9))
    assert one.keys() == many.keys()
    for i in one:
        assert one[i].score == pytest.approx(many[i].score, rel=1e-4)


def test_lm_training_is_the_average_of_its_groups():
    import pyarrow as pa

    rng, _, pair, group = lm_model(7)
    cls = rng.integers(0, lm.CLASSES, lm.IDS).astype(np.int16)
    each = [np.append(rng.integers(0, lm.END, n), lm.END) for n in rng.integers(0, 300, 20)]
    shard = [0] * 7 + [3] * 13
    shared = type("Held", (), {"value": (lm.flat(lm.initial()), pair, group, cls)})
    batch = pa.RecordBatch.from_arrays([pa.array(shard), pa.array([x.astype("<u2").tobytes() for x in each], pa.binary())], ["shard", "ids"])
    (got,) = lm._train(shared, 1)(iter([batch.slice(0, 9), batch.slice(9)]))
    expected = 0
    for g in (0, 3):
        t = lm.Trainer(shared.value[0], lm.by_group(pair, group), group, lm.RATE * 0.7, 1)
        own = [x for x, s in zip(each, shard, strict=True) if s == g]
        t.add(lm.windows_of(cls[np.concatenate(own)], np.array([len(x) for x in own])))
        expected = expected + t.end()
    assert got.column("x").to_numpy() == pytest.approx(expected, rel=1e-3, abs=1e-2)
    assert got.column("x").to_numpy()[-1] == sum(-(-len(x) // lm.CONTEXT) for x in each)


def test_lm_learns(spark):
    """After "the" stands one of twelve words, of which a text uses three: counts of pairs give each a twelfth, attention
    sees which kind of text it is in."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(0)
    kinds = [["of", "and", "to"], ["in", "is", "was"], ["for", "on", "he"], ["his", "it", "as"]]
    rows = [" ".join(f"the {kinds[i % 4][j]}" for j in rng.integers(0, 3, 60)) for i in range(2400)]
    out = lm.lm_scores(documents(spark, rows), F.col("doc_id") % 5 != 1).where("doc_id % 5 = 1").agg(F.avg("score")).first()
    assert out[0] > 60 * np.log10(1 / 12) * 0.85


def thue_morse(n, a, b):
    return "".join(b if i.bit_count() & 1 else a for i in range(n))


def test_words_that_plain_polynomials_confuse(spark):
    """Two words of 1024 letters that any polynomial modulo 2**64 over the letters takes for one."""
    from pyspark.sql import functions as F

    texts = [thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a"), "x"]
    docs = documents(spark, texts)
    got = {r.doc_id: r for r in bytebpe.digests(docs).collect()}
    assert all(got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() for i, t in enumerate(texts))
    assert {r.component_id for r in minhash.near_duplicates(docs, 3, 85).collect()} == {0, 1, 2}
    pair = [thue_morse(512, "a", "b"), thue_morse(512, "b", "a")]
    raw = collections.Counter(t[i : i + 400] for t in pair for i in range(113))
    assert max(raw.values()) == 1
    assert all(r.kept.decode() == pair[r.doc_id] for r in lpf.remove_repeats(documents(spark, pair)).collect())
    seen = {r.doc_id: r.n_known for r in lm.lm_scores(docs, F.col("doc_id") != 1).collect()}
    assert seen == {0: 2, 1: 1, 2: 2}


def test_numbered_is_unique():
    rng = np.random.default_rng(4)
    for n, of in ((0, 1), (1, 1), (50_000, 300), (50_000, 1 << 63)):
        h = rng.integers(0, of, n).astype(np.uint64) * np.uint64(2)  # some beyond 2**63
        _, first, back = np.unique(h, return_index=True, return_inverse=True)
        got = text.numbered(h)
        assert (got[0] == first).all() and (got[1] == back).all() and len(got[1]) == n


def test_pieces_are_spelled_each_by_itself():
    """Ids of many pieces at once, an empty one and one of a newline among them: of each those of the piece alone."""
    c = bytebpe.codec(*(bytebpe.public_path(x) for x in (bytebpe.RANKS, bytebpe.VOCABULARY)))
    pieces = [b" the", b"", b"\n", b"\n\n", b"", *(bytes(np.random.default_rng(i).integers(0, 256, 9).astype(np.uint8)) for i in range(40)), b"xyzzy" * 30, b""]
    ends = np.cumsum([len(x) for x in pieces])
    data = np.frombuffer(b"".join(pieces), np.uint8)
    ids, n = c._spell(data, ends - [len(x) for x in pieces], ends)
    upto = np.concatenate([[0], np.cumsum(n)])
    for piece, lo, hi in zip(pieces, upto[:-1], upto[1:], strict=True):
        body = np.frombuffer(piece, np.uint8)
        alone, _ = c._spell(body, np.array([0]), np.array([len(piece)]))
        assert ids[lo:hi].tolist() == alone.tolist() and c.decode(ids[lo:hi]).tobytes() == piece
    assert n[1] == n[4] == n[-1] == 0 and c.mark not in ids


def test_equal_hashes_are_told_apart():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    start = rng.integers(0, 3900, 3000)
    end = start + rng.integers(8, 20, 3000)
    body = [data[a:b].tobytes() for a, b in zip(start, end, strict=True)]
    sample, back = text.distinct(data, start, end, text.Ranges(data)(start, end) % np.uint64(40))
    assert len(sample) == len(set(body)) and all(body[sample[back[i]]] == body[i] for i in range(3000))
    spell = lambda d, a, b: (np.array([hash(d[i:j].tobytes()) % 1000 for i, j in zip(a, b, strict=True)], np.int32), np.ones(len(a), np.int64))
    for limit in (100_000, 50):
        memo = bytebpe.Memo(spell, limit)
        for lo in (0, 1000, 2000):
            h = text.Ranges(data)(start, end) % np.uint64(40)
            sample, back = text.distinct(data, start[lo : lo + 1000], end[lo : lo + 1000], h[lo : lo + 1000])
            s = sample + lo
            ids, n = memo.encode(data, start[s], end[s], h[s], back)
            assert ids.tolist() == [hash(x) % 1000 for x in body[lo : lo + 1000]] and (n == 1).all()
