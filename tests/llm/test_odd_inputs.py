"""Every operator on empty tables, null ids and columns, repeated rows, one very long text and columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from nocturne.llm import balltree, bytebpe, linededup, lm, lpf, minhash, mixing, rptree, tokencount, toxicity

from .test_text_operators import prose

CLASH = ["n_tokens", "score", "kept", "component_id", "ids", "spans", "did", "tid", "key", "rid", "hash", "learn", "cell", "shard", "n", "removed", "n_lines", "_p", "_all", "uid", "word", "block"]
LONG = prose(99, 60_000)  # some 300 kB


def table(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    return docs.selectExpr("*", *(f"'x' AS {c}" for c in CLASH))


ROWS = [(1, "one two three four five six", "s", "en"), (1, "one two three four five six", "s", "en"), (2, None, None, None), (3, "", "s", "en"), (None, "a null id", "s", None), (None, None, None, None), (4, LONG, "s", "en"), (5, prose(1, 90), "t", "fr"), (5, prose(1, 90), "t", "fr"), (6, prose(2, 90), "t", "fr")]


def scores(docs):
    labels = docs.sparkSession.createDataFrame([(1, 1), (6, 0), (6, None), (77, 1)], "doc_id long, toxic int")
    return toxicity.classify(docs, labels)


OPERATORS = {
    "toxicity": scores,
    "mixing": mixing.mix,
    "lines": linededup.drop_lines,
    "lm": lambda d: lm.lm_scores(d, F.col("doc_id") != 6),
    "bpe": bytebpe.digests,
    "encode": bytebpe.encode,
    "counts": tokencount.token_counts,
    "repeats": lpf.remove_repeats,
    "minhash": minhash.near_duplicates,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_text_operators(spark, name):
    got = OPERATORS[name](table(spark, ROWS)).collect()
    assert len(got) == len(ROWS)  # a row for each row
    same = lambda i: [tuple(r) for r in got if r.doc_id == i]
    for i in (1, 5):  # repeated rows have equal results
        a, b = same(i)
        assert a == b or all(x == y or x == pytest.approx(y) for x, y in zip(a, b, strict=True))
    assert len(same(None)) == 2 and len(same(4)) == 1
    assert OPERATORS[name](table(spark, ROWS).limit(0)).count() == 0
    assert len(OPERATORS[name](table(spark, [(None, None, None, None)])).collect()) == 1


def test_what_odd_rows_give(spark):
    docs = table(spark, ROWS)
    near = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    assert (near[1].component_id, near[1].kept, near[2].n_shingles, near[None].component_id, near[None].kept) == (1, True, 0, None, True)
    assert near[6].component_id == 6 and near[4].n_shingles > 50_000
    kept = {r.doc_id: r for r in mixing.mix(docs).collect()}
    assert not kept[None].kept and kept[2].tokens == 0
    long_ = [r for r in lpf.remove_repeats(docs).collect() if r.doc_id in (4, 5)]
    assert {(r.doc_id, bytes(r.kept) == b"") for r in long_} == {(4, False), (5, True)}  # rows that repeat are copies of each other
    lines = {r.doc_id: r for r in linededup.drop_lines(docs).collect()}
    assert lines[2].text is None and lines[2].n_lines == 0 and lines[3].n_lines == 1 and lines[6].score == "x"


VECTORS = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.001], 1), (3, None, 1), (4, [], 1), (5, [0.0, 0.0], 1), (6, [None, 1.0], 1), (7, [float("inf"), 1.0], 1), (None, [1.0, 0.0], 1), (8, [2.0, 0.0], None), (9, [3.0, 0.0], 1), (10, [0.0, 1.0], 2)]


def test_vector_operators(spark):
    df = spark.createDataFrame(VECTORS, "vec_id long, embedding array<double>, label int").selectExpr("*", "'x' AS id", "'x' AS tree", "'x' AS node", "'x' AS v", "'x' AS cell", "'x' AS n_links", "'x' AS score")
    got = {r.vec_id: r for r in rptree.near_vectors(df).collect()}
    assert (got[1].n_links, got[1].component_id, got[2].component_id, got[9].component_id) == (2, 1, 1, 1)
    for i in (3, 4, 5, 6, 7, 8, 10):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[None].kept and rptree.near_vectors(df.limit(0)).count() == 0
    top = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in balltree.top_k(df, F.col("vec_id") == 1, k=3).collect()}
    assert top == {(1, 1): (9, 256 * 768), (1, 2): (8, 256 * 512), (1, 3): (2, 256 * 256)}
    assert balltree.top_k(df, F.col("vec_id") == 77).count() == 0 and balltree.top_k(df.limit(0), F.col("vec_id") == 1).count() == 0
