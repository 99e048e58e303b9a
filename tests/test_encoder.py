"""The trained encoder: meaning by neighbours, the factors against numpy, hit rate against hashing, edges."""

import random

import numpy as np
from pyspark.sql import functions as F

from graniteleaf.operators import encoder, indexing, metrics, retrieval
from graniteleaf.plans import base
from graniteleaf.sources.tables import stored

COLUMNS = "chunk_id long, text string"


def test_words_of_a_topic_are_near(spark):
    """Two words that never meet, but stand in the same company, are nearer than words of other company."""
    rng = random.Random(1)
    topics = {t: [f"{t}{i}" for i in range(12)] for t in "abc"}
    docs = [(i, " ".join(rng.choices(topics["abc"[i % 3]] + (["twin1"] if i % 6 == 0 else ["twin2"] if i % 6 == 3 else ["other"] if i % 3 == 1 else []), k=20))) for i in range(300)]
    words = {r["term"]: np.array(r["vector"]) for r in encoder.train(spark.createDataFrame(docs, COLUMNS), dims=16).collect()}
    assert set(words) == {w for t in topics.values() for w in t} | {"twin1", "twin2", "other"}
    assert all(abs(np.linalg.norm(v) - 1) < 1e-5 for v in words.values())
    near, far = words["twin1"] @ words["twin2"], max(abs(words["twin1"] @ words["other"]), abs(words["twin2"] @ words["other"]))
    assert near > 2 * far, (near, far)
    same = np.mean([words[f"a{i}"] @ words[f"a{j}"] for i in range(12) for j in range(i)])
    assert same > 2 * abs(np.mean([words[f"a{i}"] @ words[f"b{j}"] for i in range(12) for j in range(12)])), same


def test_counts_and_products_are_those_of_the_whole_corpus(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choices("red green blue cyan pink grey".split(), k=rng.randint(0, 15)))) for i in range(60)] + [(100, None), (101, "")]
    got = {(r["term"], r["context"]): r["n"] for r in encoder._neighbours(spark.createDataFrame(docs, COLUMNS).repartition(5)).collect()}
    import pandas as pd

    want: dict = {}
    for _, text in docs:
        own = (text or "").split()
        for i, w in enumerate(own):
            for j in range(max(i - encoder.WINDOW, 0), min(i + encoder.WINDOW + 1, len(own))):
                if i != j:
                    key = w, int(pd.util.hash_array(np.array([own[j]], object))[0] % encoder.CONTEXTS)
                    want[key] = want.get(key, 0) + 1
    assert got == want


def test_hit_rate_is_above_hashing(spark):
    d = "/root/testdata/sf0.01"
    c, q = stored(base.corpus(spark, d), "c"), base.asked(spark, d)
    gold = stored(base.questions(spark, d).select("query_id", "gold_units").where(F.size("gold_units") > 0), "g")

    def rate(encode):
        run = retrieval.search(q, c, 6, "dense", encode=encode).withColumn("unit_id", F.col("chunk_id"))
        return metrics.metrics_at(run, gold, [6]).agg(F.avg("hit_rate")).first()[0]

    assert rate(encoder.encoder(encoder.train(c))) > rate(indexing.hash_encode)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "alone"), (4, "one two one two"), (5, "unknown words")], COLUMNS)
    words = encoder.train(docs)
    got = {r["chunk_id"]: r["embedding"] for r in encoder.encoded(docs.withColumn("embedding", F.lit("x")), words).collect()}
    assert got[1] is None and not any(got[2]) and not any(got[5]) and abs(np.linalg.norm(got[4]) - 1) < 1e-9
    none = encoder.train(docs.limit(0))
    assert none.count() == 0 and {r["chunk_id"]: r["embedding"] for r in encoder.encoded(docs, none).collect()}[4] == [0.0]
