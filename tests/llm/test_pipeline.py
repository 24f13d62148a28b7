"""The corpus pipeline on a small planted corpus, each stage and the whole against plain Python."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from nocturne.llm import mixing, toxicity

from .test_text_operators import near_by_force, prose, words

FOOT = "all rights reserved by nobody"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Toxic texts, a foot line on a third of a source's pages, near copies, and odd rows, with clashing columns."""
    rng, rows, labels = random.Random(1), [], []
    for i in range(900):
        w = prose(i, 40 + i % 50, 3000).split()
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["vile", "rotten", "filth"])
        text = " ".join(w) + (f"\n{FOOT}" if i % 3 == 1 else "")
        rows.append((i, text, rng.choice(["en", "en", "fr", "de", "es"]), f"s{i % 2}", len(text), "x", 1, 2.0))
        labels.append((i, 1, int(toxic)))
    for i in range(900, 960):  # near copies of clean documents
        of = rows[6 * (i - 900) + 2]
        text = of[1].split("\n")[0] + " tail"
        rows.append((i, text, of[2], of[3], len(text), "x", 1, 2.0))
    rows += [(960, None, "en", "s0", None, "x", 1, 2.0), (961, "", None, None, 0, "x", 1, 2.0), (962, "w " * 20_000, "en", "s1", 40_000, "x", 1, 2.0), (7, rows[7][1], *rows[7][2:])]
    folder = str(tmp_path_factory.mktemp("corpus"))
    kinds = "doc_id long, text string, lang string, source string, n_chars long, _p string, n_lines int, _toxicity double"
    spark.createDataFrame(rows, kinds).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def docs_of(spark, corpus):
    return spark.read.parquet(f"{corpus[0]}/documents.parquet")


def test_toxic_documents_go(spark, corpus):
    docs = docs_of(spark, corpus)
    out = corpus_pipeline.drop_toxic(spark, docs, corpus[0])
    assert out.columns == docs.columns
    model = toxicity.fit(docs, spark.read.parquet(f"{corpus[0]}/labels.parquet"), toxicity.fold(3) != 1)
    import pyarrow as pa

    from nocturne.llm.text import utf8

    texts = [r[1] for r in corpus[1]]
    x, cut = toxicity.features(*utf8(pa.array(texts, pa.string())))
    score = [1 / (1 + np.exp(-(model[x[i:j]].sum() + model[-1]))) for i, j in zip(cut[:-1], cut[1:], strict=True)]
    kept = sorted(r.doc_id for r in out.select("doc_id").collect())
    assert kept == sorted(r[0] for r, s in zip(corpus[1], score, strict=True) if s < toxicity.THRESHOLD)
    held = [r[0] for r in corpus[1][:900] if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert np.mean([(i in kept) == (i % 6 != 0) for i in held]) > 0.95


def test_boilerplate_goes(spark, corpus):
    docs = docs_of(spark, corpus)
    out = corpus_pipeline.drop_boilerplate(spark, docs, corpus[0])
    assert out.columns == docs.columns
    got = sorted(out.collect(), key=lambda r: r.doc_id)
    expected = sorted(corpus[1], key=lambda r: r[0])
    for r, e in zip(got, expected, strict=True):
        text = e[1].replace(f"\n{FOOT}", "") if e[1] else e[1]
        assert (r.doc_id, r.text, r.n_chars, r.n_lines, r._p) == (e[0], text, None if text is None else len(text), 1, "x")


def test_near_copies_go(spark, corpus):
    docs = docs_of(spark, corpus).where("doc_id % 3 = 2 OR doc_id >= 900 OR doc_id = 7")
    out = corpus_pipeline.drop_near_copies(spark, docs, corpus[0])
    rows = sorted(r for r in {e[:2] for e in corpus[1]} if r[0] % 3 == 2 or r[0] >= 900 or r[0] == 7)
    _, low = near_by_force([t for _, t in rows], 5, 80)
    kept = {rows[i][0] for i in range(len(rows)) if low[i] == i}
    assert len(kept) < len(rows) - 30
    assert out.columns == docs.columns and {r.doc_id for r in out.select("doc_id").collect()} == kept
    assert out.where("doc_id = 7").count() == 2  # a repeated row is not its own copy


def test_the_mixture_is_drawn_by_its_probabilities(spark, corpus):
    docs = docs_of(spark, corpus)
    out = corpus_pipeline.mix_sources(spark, docs, corpus[0])
    assert out.columns == docs.columns
    prob = {r.doc_id: r.prob for r in mixing.mix(docs).collect()}
    chance = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) / 2**32
    assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(r[0] for r in corpus[1] if chance(r[0]) < prob[r[0]])


def test_the_last_stage_encodes(spark, corpus):
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = docs_of(spark, corpus).where("doc_id % 9 = 1 OR doc_id > 950")
    text = {r[0]: r[1] or "" for r in corpus[1]}
    for r in corpus_pipeline.encode(spark, docs, corpus[0]).collect():
        ids = library.encode_ordinary(text[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text[r.doc_id].encode()).hexdigest())


def test_the_whole_is_its_stages(spark, corpus):
    got = {(r.doc_id, r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, corpus[0]).collect()}
    docs = docs_of(spark, corpus)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, corpus[0]).collect(), docs.schema)
    last = docs.collect()
    assert 50 < len(last) < 700 and {(i, h) for i, _, h in got} == {(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in last}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "minhash", "mixing", "byte_bpe"]
    assert all(len(words(r.text)) == len(words(r.text.replace(FOOT, ""))) for r in last if r.text)


def test_empty_tables(spark, corpus, tmp_path):
    docs_of(spark, corpus).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{corpus[0]}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
