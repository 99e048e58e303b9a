"""Near words and their forms against plain search, hot blocks, and edges."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from graniteleaf.llm import spelling

COLUMNS = "doc_id long, text string"


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts: dict[str, int]) -> dict[str, tuple]:
    """word -> (n, n_near, best, best_n) by comparing every word with every other."""
    near = defaultdict(list)
    words = sorted(counts)
    for i, a in enumerate(words):
        for b in words[i + 1 :]:
            if abs(len(a) - len(b)) < 2 and one_edit(a, b):
                near[a].append(b)
                near[b].append(a)
    best = {w: min(near[w], key=lambda x: (-counts[x], x)) if near[w] else None for w in words}
    return {w: (counts[w], len(near[w]), best[w], counts.get(best[w])) for w in words}


def near(spark, counts, **bounds):
    rows = spelling.near(spark.createDataFrame(list(counts.items()), "word string, n long"), **bounds).collect()
    assert len(rows) == len(counts)
    return {r["word"]: (r["n"], r["n_near"], r["best"], r["best_n"]) for r in rows}


def words(seed: int, many: int, letters: str = "abé", start: str = "") -> dict[str, int]:
    """Words over few letters, so that many are near; equal counts are common."""
    rng = random.Random(seed)
    made: dict[str, int] = {}
    while len(made) < many:
        made[start + "".join(rng.choices(letters, k=rng.randint(7 - min(len(start), 4), 10)))[: 14 - len(start)].ljust(7, "a")] = rng.randint(2, 5)
    return {w: n for w, n in made.items() if len(w) >= 7}


def test_wavelet_tree_reports_boxes():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 64, 100):
        values = rng.permutation(n)
        tree = spelling.WaveletTree(values)
        a, b, c, d = (rng.integers(0, n + 1, 40) for _ in range(4))
        q, v = tree.report(a, np.maximum(a, b), c, np.maximum(c, d))
        for k in range(40):
            inside = values[a[k] : max(a[k], b[k])]
            assert sorted(v[q == k]) == sorted(inside[(inside >= c[k]) & (inside < max(c[k], d[k]))])


def test_near_words_of_dense_vocabulary(spark):
    counts = words(1, 700) | {"aaaaaaa": 9, "aaaaaaaa": 9, "aaaaaaaaa": 1, "abcdefgh": 2, "abcdefg": 2, "xbcdefg": 2, "xabcdefg": 2, "abcdefgx": 2}
    assert near(spark, counts) == plain(counts)


def test_hot_beginnings_and_endings_are_cut(spark):
    """A third of the words begins alike, a third ends alike, and blocks may hold only a few of them."""
    counts = words(2, 250) | words(3, 250, start="con") | {w[::-1]: n for w, n in words(4, 250, start="noi").items()}
    assert near(spark, counts, block=10, task=100) == plain(counts)
    assert near(spark, counts, block=2, task=50) == plain(counts)


def test_long_words(spark):
    long = "ab" * 400
    counts = {long: 20, long[:300] + "x" + long[301:]: 2, long + "b": 3, long[1:]: 2, "a" * 500: 4, "a" * 501: 40, "b" * 900: 2}
    assert near(spark, counts, block=1) == plain(counts)


def test_counts_are_of_whole_texts_with_slips(spark):
    rng = random.Random(7)
    docs = [(i, " ".join(rng.choices(["Wörterbuch", "ÀÉÎÕÜßÿ", "straightforward", "abc", "straight×forward", "naïveté7naïvetés", "ĀstraightĀ"], k=200))) for i in range(40)] + [(None, "straightforward " * 5), (3, None), (4, ""), (5, "x" * 50_000 + " Straightforward")]
    got = {r["word"]: r["n"] for r in spelling.count_words(spark.createDataFrame(docs, COLUMNS), slips=31).collect()}
    want: Counter[str] = Counter()
    for i, text in docs:
        run = ""
        for c in (text or "") + " ":
            if "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ÿ":
                run += c.lower() if c <= "Z" else c
            elif run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                if h % 31 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                want[run] += 1
                run = ""
    assert got == {w: n for w, n in want.items() if len(w) >= 7}


def test_forms_and_roots(spark):
    said = {"governmint": 2, "government": 25, "governments": 300, "governmants": 40, "unrelated": 3, "unrelatedx": 29}
    docs = [(1, " ".join(w for w, n in said.items() for _ in range(n))), (2, "seldomly")]
    got = {r["word"]: (r["form"], r["root"], r["n_near"], r["form_n"]) for r in spelling.variants(spark.createDataFrame(docs, COLUMNS)).collect()}
    assert got == {
        "governmint": ("government", "governments", 1, 25), "government": ("governments", "governments", 2, 300), "governments": (None, "governments", 2, None),
        "governmants": (None, "governmants", 1, None), "unrelated": (None, "unrelated", 1, None), "unrelatedx": (None, "unrelatedx", 1, None),
    }


def test_roots_of_long_chains(spark):
    forms = [(f"w{i:03}", f"w{i + 1:03}") for i in range(20)] + [("x", "w003"), ("y", "z")]
    got = {r["word"]: r["root"] for r in spelling.roots(spark.createDataFrame(forms, "word string, form string")).collect()}
    assert got == {f"w{i:03}": "w020" for i in range(20)} | {"x": "w020", "y": "z"}


def test_edges(spark):
    empty = spelling.variants(spark.createDataFrame([], COLUMNS))
    assert empty.count() == 0 and set(empty.columns) == {"word", "n", "n_near", "form", "form_n", "root"}
    rows = [(None, None, 1, "a"), (1, "", 2, "b"), (1, "12 !! ab", 3, "c"), (2, "Mississippi mississippi", 4, "d"), (2, "Mississippi mississippi", 4, "d")]
    got = spelling.variants(spark.createDataFrame(rows, COLUMNS + ", n long, word string")).collect()
    assert [tuple(r.asDict().get(k) for k in ("word", "n", "n_near", "form", "root")) for r in got] == [("mississippi", 4, 0, None, "mississippi")]
    with pytest.raises(ValueError, match="at least 7"):
        spelling.variants(spark.createDataFrame([], COLUMNS), least=6)
