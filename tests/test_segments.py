"""An index that changes against one that is built anew."""

import random

import pytest
from pyspark.sql import functions as F

from graniteleaf.operators import retrieval, segments

COLUMNS = "chunk_id long, text string"


def ranks(df):
    return {(r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in df.collect()}


def test_changes_are_as_a_rebuild(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    say = lambda: " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randint(0, 30)))
    queries = spark.createDataFrame([(i, " ".join(f"w{rng.randint(1, 20)}" for _ in range(3))) for i in range(12)] + [(99, None)], "query_id long, question string")
    path, live = f"file://{tmp_path}/index", {}

    def same():
        want = retrieval.bm25(queries, spark.createDataFrame(list(live.items()), COLUMNS), 7)
        got = ranks(segments.search(queries, path, 7))
        assert got == ranks(want) and got
        return got

    for version, ids in enumerate((range(60), range(60, 80), (5, 6, 70, 200)), 1):
        part = {i: say() for i in ids}
        live |= part
        assert segments.add(spark.createDataFrame(list(part.items()), COLUMNS), path) == version
    gone = [0, 5, 61, 200, 7, 12345]
    assert segments.delete(spark.createDataFrame([(i,) for i in gone] + [(None,)], "chunk_id long"), path) == 4
    live = {i: t for i, t in live.items() if i not in gone}
    same()
    assert segments.delete(spark.createDataFrame([(5,)], "chunk_id long"), path) == 4
    live[5] = "w1 w2 back"
    segments.add(spark.createDataFrame([(5, live[5])], COLUMNS), path)
    before = same()
    monkeypatch.setattr(segments, "MOST_TERMS", 1)
    assert segments.merge(spark, path) == 6 and same() == before
    monkeypatch.undo()
    m = segments.manifest(spark, path)
    assert len(m["segments"]) == 1 and not m["dead"]
    assert len(segments.vacuum(spark, path)) > 6 and same() == before and segments.vacuum(spark, path) == []
    assert segments.merge(spark, path) == 6


def test_writers_do_not_overwrite_each_other(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/index"
    segments.add(spark.createDataFrame([(1, "one two")], COLUMNS), path)
    old = segments.manifest(spark, path)
    segments.add(spark.createDataFrame([(2, "two three")], COLUMNS), path)
    monkeypatch.setattr(segments, "manifest", lambda *_: old)
    with pytest.raises(segments.Conflict):
        segments.delete(spark.createDataFrame([(1,)], "chunk_id long"), path)
    monkeypatch.undo()
    q = spark.createDataFrame([(1, "two")], "query_id long, question string")
    assert {r["chunk_id"] for r in segments.search(q, path).collect()} == {1, 2}


def test_edges(spark, tmp_path):
    path, q = f"file://{tmp_path}/index", spark.createDataFrame([(1, "two")], "query_id long, question string")
    assert segments.search(q, path).count() == 0 and segments.merge(spark, path) == 0 and segments.delete(spark.createDataFrame([(1,)], "chunk_id long"), path) == 0
    assert segments.add(spark.createDataFrame([], COLUMNS), path) == 0
    segments.add(spark.createDataFrame([("a", None), ("b", ""), ("c", "two")], "chunk_id string, text string").withColumn("segment", F.lit("x")), path)
    assert [(r["chunk_id"], r["rank"]) for r in segments.search(q, path).collect()] == [("c", 1)]
    segments.delete(spark.createDataFrame([("a",), ("b",), ("c",)], "chunk_id string"), path)
    assert segments.search(q, path).count() == 0
