"""The random field against enumeration, held-out accuracy, code-switched text, and edges."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graniteleaf.llm import language_id

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string"
SYLLABLES = {"aa": ["ber", "gen", "sch", "ung", "heit"], "bb": ["cion", "ado", "ez", "mente", "os"], "cc": ["eau", "elle", "oi", "eux", "ment"]}


def said(rng: random.Random, lang: str, n: int) -> list[str]:
    return ["".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n)]


def corpus(n: int = 150) -> list[tuple]:
    rng = random.Random(4)
    langs = sorted(SYLLABLES)
    return [(i, " ".join(said(rng, langs[i % 3], rng.randint(5, 60))).capitalize() + ".", langs[i % 3]) for i in range(n)]


@pytest.fixture(scope="module")
def model(spark):
    return language_id.fit(spark.createDataFrame(corpus(), COLUMNS))


@pytest.mark.parametrize("pairs", [False, True])
def test_forward_backward_against_enumeration(pairs, monkeypatch):
    """Sequences shorter and longer than a stretch, all their labellings written out."""
    monkeypatch.setattr(language_id, "STEP", 3)
    rng = np.random.default_rng(1)
    offset = np.array([0, 1, 8, 10, 16])
    scores, moves, start = rng.normal(size=(16, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    got, expected, log_z = language_id.chain(scores, offset, moves, start, pairs)
    want, want_moves, want_z = np.zeros((16, 3)), np.zeros((3, 3)), 0.0
    for a, b in itertools.pairwise(offset):
        ways = np.array(list(itertools.product(range(3), repeat=b - a)))
        logs = start[ways[:, 0]] + scores[np.arange(a, b), ways].sum(1) + moves[ways[:, :-1], ways[:, 1:]].sum(1)
        z = np.logaddexp.reduce(logs)
        p = np.exp(logs - z)
        want_z += z
        for w, q in zip(ways, p, strict=True):
            want[np.arange(a, b), w] += q
            np.add.at(want_moves, (w[:-1], w[1:]), q)
    np.testing.assert_allclose(got, want, atol=1e-12)
    assert log_z == pytest.approx(want_z)
    if pairs:
        np.testing.assert_allclose(expected, want_moves, atol=1e-12)


def test_gradient_is_that_of_the_likelihood(spark):
    rows = spark.createDataFrame(corpus(12), COLUMNS).select("lang", "text")
    sequences = language_id._sequences(rows, ["aa", "bb", "cc"], {})
    rng = np.random.default_rng(0)
    w, m, s = rng.normal(size=(language_id.SLOTS, 3)) * 0.1, rng.normal(size=(3, 3)), rng.normal(size=3)
    _, value, gw, gm, gs = language_id._gradient(sequences, w, m, s)
    dw, dm, ds, h = rng.normal(size=w.shape), rng.normal(size=m.shape), rng.normal(size=3), 1e-6
    _, more, *_ = language_id._gradient(sequences, w + h * dw, m + h * dm, s + h * ds)
    assert (more - value) / h == pytest.approx((gw * dw).sum() + (gm * dm).sum() + (gs * ds).sum(), rel=1e-3)


def test_climb_finds_the_maximum():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(30, 10))
    h, b = a.T @ a + 0.1 * np.eye(10), rng.normal(size=10)
    x = language_id.climb(lambda x: (b @ x - x @ h @ x / 2, b - h @ x), np.zeros(10), 200)
    assert b @ x - x @ h @ x / 2 == pytest.approx(b @ np.linalg.solve(h, b) / 2, rel=1e-3)


def test_held_out_accuracy_on_the_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in language_id.predicted(docs).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    assert len(got) == len(truth) and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for i, r in got.items())
    held = [(r["lang_pred"], truth[i]) for i, r in got.items() if r["held_out"] and truth[i] is not None]
    assert len(held) > 30 and np.mean([a == b for a, b in held]) > 0.97


def test_code_switched_text_is_labelled_by_word(spark, model):
    rng = random.Random(9)
    docs, truth = [], {}
    for i in range(60):
        parts = [(lang, said(rng, lang, rng.randint(8, 30))) for lang in rng.sample(sorted(SYLLABLES), 3)]
        docs.append((i, " - ".join(", ".join(w) for _, w in parts), None))
        truth[i] = [lang for lang, w in parts for _ in w]
    runs = language_id.spans(spark.createDataFrame(docs, COLUMNS), model).orderBy("doc_id", "run").collect()
    said_ = {i: [] for i in truth}
    for r in runs:
        assert r["first"] == len(said_[r["doc_id"]]) and 0 < r["score"] <= 1.0000001
        said_[r["doc_id"]] += [r["lang"]] * r["n_words"]
    assert all(len(said_[i]) == len(truth[i]) for i in truth)
    assert np.mean([a == b for i in truth for a, b in zip(said_[i], truth[i], strict=True)]) > 0.97
    assert np.mean([max(r["run"] for r in runs if r["doc_id"] == i) == 2 for i in truth]) > 0.9
    # staying is likelier than any move, by what was learnt
    assert all(model.moves[k].argmax() == k for k in range(3))


def test_long_texts_and_languages_of_whole_texts(spark, model):
    rng = random.Random(2)
    long = " ".join(said(rng, "aa", 300) + said(rng, "bb", 30_000))
    rows = [(1, long, None), (2, " ".join(said(rng, "cc", 1)), None), (3, "x" * 3_000_000, None), (4, long, None)]
    got = {r["doc_id"]: r for r in language_id.identified(spark.createDataFrame(rows, COLUMNS), model).collect()}
    assert got[1]["lang_pred"] == "bb" and 0.95 < got[1]["score"] < 0.995 and got[1]["score"] == got[4]["score"]
    assert got[3]["lang_pred"] in model.languages


def test_edges(spark, model):
    rows = [(1, None, "aa"), (2, "", "bb"), (3, "12 34 -- !", None), (4, "… «» 🙂", None), (None, "berung heitgen", None), (None, "berung heitgen", None), (6, "字", None)]
    got = language_id.identified(spark.createDataFrame(rows, COLUMNS).withColumn("score", F.lit("mine")), model).collect()
    assert [(r["lang_pred"], r["score"]) for r in got[:4]] == [("und", 0.0)] * 4
    assert got[4]["lang_pred"] == got[5]["lang_pred"] == "aa" and got[6]["lang_pred"] in model.languages
    assert got[0].asDict().keys() == {"doc_id", "text", "lang", "lang_pred", "score"}
    assert language_id.predicted(spark.createDataFrame([], COLUMNS)).count() == 0
    assert language_id.spans(spark.createDataFrame(rows[:4], COLUMNS), model).count() == 0


def test_no_language_or_one(spark):
    none = language_id.predicted(spark.createDataFrame([(1, "berung", None), (2, None, "aa")], COLUMNS)).collect()
    assert {(r["doc_id"], r["lang_pred"], r["score"]) for r in none} == {(1, "und", 0.0), (2, "und", 0.0)}
    one = language_id.predicted(spark.createDataFrame([(i, "berung" if i % 2 else "77", "aa") for i in range(8)], COLUMNS)).collect()
    assert {(r["lang_pred"], r["score"]) for r in one} == {("aa", 1.0), ("und", 0.0)}


def test_only_rows_that_are_not_held_out_teach(spark):
    """Held-out rows carry a language that no other row has: it must not be known."""
    rows = [(i, " ".join(said(random.Random(i), "bb", 9)), "secret" if zlib.crc32(str(i).encode()) % 4 == 2 else "bb") for i in range(40)]
    assert {r["lang_pred"] for r in language_id.predicted(spark.createDataFrame(rows, COLUMNS)).collect()} == {"bb"}
