"""Tokens that are cut in Arrow buffers, and vectors from their counts."""

import pytest
from pyspark.sql import functions as F

from graniteleaf.functions import text as T
from graniteleaf.operators import indexing, retrieval

TEXTS = ["a b a 12", "", None, "Ünd İstanbul xKy ß9", "tail", "head tail", " --- ", "ab\ncd\tAB", "naïve–Zürich 日本a1b語", "x" * 300 + " y"]


@pytest.mark.parametrize("most", [1, 16, 1 << 22])
def test_tokens_and_vectors_are_those_of_the_columns(spark, monkeypatch, most):
    monkeypatch.setattr(indexing, "CUT_BYTES", most)
    monkeypatch.setattr(indexing, "COUNTED", most)
    c = spark.createDataFrame(list(enumerate(TEXTS)), "chunk_id long, text string").repartition(2)
    counted = indexing.token_counts(c)
    got = {r["chunk_id"]: (r["dl"], r["tokens"] if r["tokens"] is None else dict(zip(r["tokens"], r["counts"]))) for r in counted.collect()}
    want = {r[0]: (r[2], r[1] if r[1] is None else {t: r[1].count(t) for t in r[1]}) for r in indexing.document_lengths(c).collect()}
    assert got == want and len(got) == len(TEXTS)
    vectors = {r[0]: r[1] for r in indexing.hash_vectors(counted).collect()}
    assert vectors == {r[0]: r[1] for r in c.select("chunk_id", F.when(F.col("text").isNotNull(), indexing.hash_encode(F.col("text")))).collect()}
    assert indexing.hash_vectors(indexing.token_counts(c.limit(0))).count() == 0
    assert {tuple(r) for r in indexing.term_statistics(counted).collect()} == {tuple(r) for r in indexing.term_statistics(indexing.document_lengths(c)).collect()}


def test_texts_are_cut_once_and_terms_counted_once(spark):
    """Both legs read the same counts; document frequencies, which the terms and their mean read, are one shuffle."""
    c = spark.createDataFrame([(i, "article", f"w{i % 7} w{i % 3} x") for i in range(50)], "chunk_id long, kind string, text string")
    q = spark.createDataFrame([(1, "w1 x"), (2, "w2")], "query_id long, question string")
    counted = indexing.token_counts(c)
    runs = [retrieval.search(q, c, 5, m, counted=counted) for m in ("bm25", "dense")]
    assert all("regexp_extract_all(" not in r._jdf.queryExecution().optimizedPlan().toString() for r in runs)
    assert sorted(map(tuple, retrieval.search(q, c, 5, "dense").collect())) == sorted(map(tuple, runs[1].collect()))
    stats = indexing.term_statistics(counted).join(q.select(F.explode(T.tokenize(F.col("question"))).alias("term")), "term")
    stats.collect()
    assert "ReusedExchange" in stats._jdf.queryExecution().executedPlan().toString()


def test_null_texts_leave_neighbours_of_others_whole(spark):
    c = spark.createDataFrame([(0, "k", None), (1, "k", "w1 x"), (2, "k", "x")], "chunk_id long, kind string, text string").coalesce(1)
    q = spark.createDataFrame([(1, "w1 x")], "query_id long, question string")
    assert [r["chunk_id"] for r in retrieval.search(q, c, 1, "dense").collect()] == [1]


@pytest.mark.parametrize("most", [1, 16, 1 << 22])
def test_only_what_is_asked_for_leaves_the_cut(spark, monkeypatch, most):
    """Frequencies of all tokens come with it, in one pass over the texts."""
    for name in ("CUT_BYTES", "HELD", "CARRIED"):
        monkeypatch.setattr(indexing, name, most)
    c = spark.createDataFrame(list(enumerate(TEXTS)), "chunk_id long, text string").repartition(2)
    words = {"a", "ab", "tail", "nowhere", "12"}
    got = indexing.asked_counts(c, sorted(words))
    rows = {r["chunk_id"]: (r["dl"], r["tokens"] if r["tokens"] is None else dict(zip(r["tokens"], r["counts"]))) for r in got.where("NOT summed").collect()}
    assert rows == {r[0]: (r[2], r[1] if r[1] is None else {t: r[1].count(t) for t in r[1] if t in words}) for r in indexing.document_lengths(c).collect()}
    want = {tuple(r) for r in indexing.term_statistics(indexing.document_lengths(c)).collect()}
    assert {tuple(r) for r in indexing.term_statistics(got).collect()} == want and len(want) > len(words)
    assert indexing.asked_counts(c.limit(0), ["a"]).count() == 0


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_bm25_stores_no_other_tokens(spark, monkeypatch, most):
    kept = []
    monkeypatch.setattr(retrieval, "ASKED_TERMS", most)
    monkeypatch.setattr(retrieval, "stored", lambda df, name: kept.append(df) or df)
    c = spark.createDataFrame([(i, f"w{i % 7} w{i % 3} x own{i}") for i in range(50)] + [(50, None)], "chunk_id long, text string")
    q = spark.createDataFrame([(1, "w1 x"), (2, "w2 w2 nowhere"), (3, None)], "query_id long, question string")
    got = sorted(map(tuple, retrieval.bm25(q, c, 5).collect()))
    assert got == sorted(map(tuple, retrieval.top_k(retrieval.bm25_scores(q, c), 5, 6).collect())) and len(got) == 10
    if most:
        assert {t for r in kept[0].where("NOT summed").collect() for t in r["tokens"] or ()} == {"w1", "w2", "x"}
