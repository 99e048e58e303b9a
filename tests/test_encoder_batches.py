"""The trained encoder on batches that do not fit in memory as padded strings."""

from graniteleaf.operators import encoder


def test_one_very_long_token_costs_its_own_length(spark):
    """An array of strings of equal width would take 60,000 times the longest one: 240 GB."""
    docs = spark.createDataFrame([(0, "z" * 1_000_000 + " a b")] + [(i, "a b c d e f" * 10) for i in range(1, 1001)], "chunk_id long, text string").coalesce(1)
    got = {(r["term"][:2], r["n"]) for r in encoder._neighbours(docs.where("chunk_id = 0")).collect()}
    assert got == {("zz", 1), ("a", 1), ("b", 1)}
    assert {r["term"] for r in encoder.train(docs, dims=4).collect()} == {"a", "b", "c", "d", "e", "f", "fa"}


def test_slices_of_few_tokens_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 17}" for j in range(i % 23))) for i in range(200)] + [(500, None)], "chunk_id long, text string").coalesce(1)
    want = sorted(map(tuple, encoder._neighbours(docs).collect()))
    words = encoder.train(docs, dims=4)
    vectors = sorted((r["chunk_id"], r["embedding"]) for r in encoder.encoded(docs, words).collect())
    monkeypatch.setattr(encoder, "TOKENS", 30)
    assert sorted(map(tuple, encoder._neighbours(docs).collect())) == want and want
    assert sorted((r["chunk_id"], r["embedding"]) for r in encoder.encoded(docs, words).collect()) == vectors
