"""Block index and pattern automaton against plain forms."""

import random

import pytest
from pyspark.sql import functions as F

from graniteleaf.operators import matching, postings, retrieval


def ranks(df):
    return {(r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in df.collect()}


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    zipf = [1 / (i + 1) for i in range(400)]
    rows = [(i, "article", " ".join(rng.choices(words, zipf, k=rng.randint(1, 120)))) for i in range(1500)]
    return spark.createDataFrame(rows + [(9001, "article", ""), (9002, "article", None), (9003, "article", "w1 w1 w1"), (9004, "article", "w1 w1 w1")], "chunk_id long, kind string, text string")


def test_same_rows_as_all_postings_and_fewer_blocks(spark, corpus, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "BUCKET", 16)
    path = f"file://{tmp_path}/index"
    postings.build(corpus, path)
    rng = random.Random(4)
    asked = [(i, " ".join(f"w{rng.randint(0, 399)}" for _ in range(rng.randint(1, 4)))) for i in range(30)] + [(100, "w0"), (101, "nowhere"), (102, None), (103, ""), (104, "w1 w1 nowhere w300")]
    queries = spark.createDataFrame(asked, "query_id long, question string")
    for k in (1, 7):
        assert ranks(postings.search(queries, path, k)) == ranks(retrieval.bm25(queries, corpus, k))
    read = {r["query_id"]: r for r in postings.buckets_read(queries, path, 3).collect()}
    assert read[100]["buckets"] > 50 and sum(r["first"] + r["more"] for r in read.values()) < 0.6 * sum(r["buckets"] for r in read.values())
    gaps = spark.read.parquet(f"{path}/blocks").select(F.min(F.array_min("gaps")), F.max(F.aggregate("gaps", F.lit(0), lambda a, b: a + b))).first()
    assert gaps[0] >= 0 and gaps[1] < 16


def test_block_index_edges(spark, corpus, tmp_path):
    queries = spark.createDataFrame([(1, "w1 w2")], "query_id long, question string")
    postings.build(corpus.limit(0), f"file://{tmp_path}/none")
    assert postings.search(queries, f"file://{tmp_path}/none").count() == 0
    postings.build(corpus.where("chunk_id > 9000"), f"file://{tmp_path}/few")
    assert ranks(postings.search(queries, f"file://{tmp_path}/few")) == ranks(retrieval.bm25(queries, corpus.where("chunk_id > 9000")))
    with pytest.raises(ValueError, match="at least 1"):
        postings.search(queries, f"file://{tmp_path}/few", 0)


def test_patterns_within_texts(spark, monkeypatch):
    texts = [(1, "abcabc"), (2, "xbcx"), (3, None), (4, ""), (5, "ABC"), (1, "abcabc"), (None, "bc é 字")]
    patterns = [(1, "abc"), (2, "bc"), (3, "bc"), (4, ""), (5, None), (6, "é 字"), (7, "cab")]
    t, p = spark.createDataFrame(texts, "text_id long, text string"), spark.createDataFrame(patterns, "pattern_id long, pattern string")
    want = sorted((str(i), k) for i, x in texts for k, y in patterns if x is not None and y is not None and y in x)
    for size in (1 << 20, 1):
        monkeypatch.setattr(matching, "SHARD_BYTES", size)
        got = matching.containing(t, p)
        assert sorted((str(r["text_id"]), r["pattern_id"]) for r in got.collect()) == want
        assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert matching.containing(t, p.limit(0)).count() == matching.containing(t.limit(0), p).count() == 0
