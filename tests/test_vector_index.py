"""The quantised vector index: recall against exact neighbours, what is read, edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graniteleaf.operators import retrieval, vector_index

COLUMNS = "chunk_id long, embedding array<float>"


def unit(x):
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def rows(x):
    return [(i, v.tolist()) for i, v in enumerate(x)]


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["chunk_id"], r["score"]))
    return {q: sorted(v) for q, v in out.items()}


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    near = rng.normal(size=(40, 30))[rng.integers(0, 40, 3000)] + 0.6 * rng.normal(size=(3000, 30))
    # a third are copies of one vector
    return spark.createDataFrame(rows(unit(np.concatenate((near, np.repeat(near[:1], 1500, axis=0))))), COLUMNS)


def test_recall_and_what_is_read(spark, vectors, tmp_path):
    path = f"file://{tmp_path}/index"
    vector_index.build(vectors, path)
    asked = vectors.where("chunk_id % 20 = 1 AND chunk_id < 3000").select(F.col("chunk_id").alias("query_id"), "embedding")
    exact, got = found(retrieval.dense(asked, vectors, 10)), found(vector_index.search(asked, path, 10, probed=0.3))
    assert got.keys() == exact.keys() and all(len(v) == 10 for v in got.values())
    score = {q: {c: s for _, c, s in v} for q, v in exact.items()}
    assert np.mean([[c in score[q] for _, c, _ in got[q]] for q in got]) > 0.9
    assert all(s == pytest.approx(score[q][c], abs=1.1e-5) for q in got for _, c, s in got[q] if c in score[q])
    stored = spark.read.parquet(f"{path}/rows")
    assert stored.count() == 4500 and stored.select(F.max(F.length("code"))).first()[0] == 8  # a byte for four of 30 entries
    assert stored.select("list").distinct().count() > 30


def test_equal_vectors_are_all_indexed(spark, vectors, tmp_path):
    path = f"file://{tmp_path}/index"
    vector_index.build(vectors, path)
    hub = vectors.where("chunk_id = 4000").select(F.col("chunk_id").alias("query_id"), "embedding")
    got = found(vector_index.search(hub, path, 200))[4000]
    assert len(got) == 200 and all(s == 1.0 for _, _, s in got)


def test_edges(spark, tmp_path):
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id long, embedding array<float>")
    for i, data in enumerate(([], [(1, None)])):
        vector_index.build(spark.createDataFrame(data, COLUMNS), f"file://{tmp_path}/{i}")
        assert vector_index.search(asked, f"file://{tmp_path}/{i}", 3).count() == 0
    few = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", None), ("d", [0.6, 0.8])], "chunk_id string, embedding array<float>")
    vector_index.build(few, f"file://{tmp_path}/few")
    assert found(vector_index.search(asked, f"file://{tmp_path}/few", 3, probed=1.0)) == {1: [(1, "a", 1.0), (2, "d", 0.6), (3, "b", 0.0)]}


def test_expressions_are_encoded_once(spark):
    """The vectors of a search may be computed: their expression stands once in the plan."""
    docs = spark.createDataFrame([(1, "one two"), (2, None), (3, "two three")], "chunk_id long, text string")
    from graniteleaf.operators import indexing

    v = docs.select("chunk_id", indexing.hash_encode(F.col("text")).alias("embedding"))
    q = docs.where("chunk_id = 1").select(F.col("chunk_id").alias("query_id"), indexing.hash_encode(F.col("text")).alias("embedding"))
    got = retrieval.dense(q, v, 2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("isnotnull(embedding") == 0 and {r["chunk_id"] for r in got.collect()} == {1, 3}
