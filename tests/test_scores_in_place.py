"""BM25 scores that are taken where chunks lie."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graniteleaf.operators import postings, retrieval, segments

COLUMNS = "chunk_id long, text string"


def corpus(spark, n=300):
    rng = random.Random(3)
    docs = [(i, " ".join(f"w{int(rng.paretovariate(0.8))}" for _ in range(rng.randint(0, 40)))) for i in range(n)] + [(n, None), (n + 1, "w1 w1 w1 w2")]
    questions = [(i, " ".join(f"w{rng.randint(1, 9)}" for _ in range(6))) for i in range(20)] + [(50, None), (51, ""), (52, "nowhere")]
    return spark.createDataFrame(questions, "query_id long, question string"), spark.createDataFrame(docs, COLUMNS).repartition(3)


def rows(df):
    return sorted(map(tuple, df.select("query_id", "chunk_id", "score", "rank").collect()))


@pytest.mark.parametrize("tile", [1 << 20, 64])
def test_rows_are_those_of_all_pairs(spark, monkeypatch, tile):
    q, c = corpus(spark)
    want = rows(retrieval.top_k(retrieval.bm25_scores(q, c), 7, 6))
    monkeypatch.setattr(retrieval, "TILE", tile)
    monkeypatch.setattr(retrieval, "TOKENS", 1 << 17 if tile > 64 else 50)
    monkeypatch.setattr(retrieval, "PAIRS", 1 << 18 if tile > 64 else 40)
    assert rows(retrieval.bm25(q, c, 7)) == want and want
    assert rows(retrieval.bm25(q, c.withColumn("chunk_id", F.format_string("%05d", "chunk_id")), 7)) == [(a, f"{b:05}", s, r) for a, b, s, r in want]
    assert retrieval.bm25(q, c.limit(0), 7).count() == 0 and retrieval.bm25(q.limit(0), c, 7).count() == 0


def test_pairs_of_question_and_chunk_are_not_shuffled(spark, tmp_path):
    """What is dealt out by question is the k best of each task."""
    q, c = corpus(spark)
    segments.add(c, f"file://{tmp_path}/index")
    for df in (retrieval.bm25(q, c, 7), segments.search(q, f"file://{tmp_path}/index", 7)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and not any(x in plan.split("MapInArrow")[0] for x in ("Join", "Aggregate"))


def test_blocks_of_a_bucket_are_not_sent_to_each_question(spark, tmp_path, monkeypatch):
    q, c = corpus(spark)
    path = f"file://{tmp_path}/blocks"
    postings.build(c, path)
    want = rows(retrieval.bm25(q, c, 7))
    assert rows(postings.search(q, path, 7)) == want
    blocks, chunks = spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/chunks")
    asked = q.select("query_id", F.explode(retrieval.T.tokenize(F.col("question"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    wanted = asked.select("query_id").distinct().crossJoin(chunks.select("bucket"))
    made = postings._scored(wanted, asked, blocks, chunks, 7, retrieval.DEFAULT)
    met = [x for x in made._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate [" in x and "gaps" in x]
    assert met and not any("query_id" in x.split("]")[0] for x in met)
    monkeypatch.setattr(retrieval, "PAIRS", 40)
    assert rows(postings.search(q, path, 7)) == want


def drawn(seed, negative):
    """Questions by term, and (chunk, term, factor) of 40 chunks; the first terms are frequent on both sides."""
    rng = np.random.default_rng(seed)
    weight = np.abs(rng.normal(2, 1, 60)) + 0.01
    weight[::7] *= -1 if negative else 1
    often = 1 / np.arange(1, 61) / sum(1 / np.arange(1, 61))
    asked = retrieval.Asked([(q, [(f"w{t:02}", weight[t] * rng.integers(1, 3)) for t in rng.choice(60, rng.integers(1, 20), False, often)]) for q in range(50)])
    held = often[: len(asked.terms)] / often[: len(asked.terms)].sum()
    pairs = np.unique([c * len(asked.terms) + t for c in range(39) for t in rng.choice(len(asked.terms), 15, p=held)])
    return asked, pairs // len(asked.terms), pairs % len(asked.terms), rng.uniform(0.3, 2.4, len(pairs))


@pytest.mark.parametrize("sparse", [0, 3, 400, 1 << 40])
@pytest.mark.parametrize("negative", [False, True])
def test_frequent_terms_in_a_matrix_product_score_the_same(monkeypatch, sparse, negative):
    monkeypatch.setattr(retrieval, "SPARSE", sparse)
    for seed in range(5):
        asked, chunk, term, factor = drawn(seed, negative)
        want = np.full((50, 40), -np.inf)
        for c, t, f in zip(chunk, term, factor):
            for e in range(asked.start[t], asked.start[t + 1]):
                q = asked.of[e]
                want[q, c] = asked.gain[e] * f + (want[q, c] if want[q, c] > -np.inf else 0)
        got = asked.scores(chunk, term, factor, 40, 6)
        assert ((got == -np.inf) == (want == -np.inf)).all() and np.allclose(got[got > -np.inf], want[want > -np.inf], atol=1e-6)


def test_a_term_in_all_questions_and_chunks_makes_no_product_for_each_pair(monkeypatch):
    made, bincount = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda x, weights=None, minlength=0: (made.append(len(x) if weights is not None else 0), bincount(x, weights, minlength))[1])
    asked = retrieval.Asked([(q, [("the", 0.1), (f"w{q:03}", 3.0)]) for q in range(200)])
    the, n = asked.terms.to_pylist().index("the"), 300
    chunk, term = np.concatenate([np.arange(n), np.arange(n)]), np.concatenate([np.full(n, the), np.arange(n) % 200])
    got = asked.scores(chunk, term, np.ones(2 * n), n, 6)
    assert (got > 0).all() and sum(made) < 200 * n / 10
