"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Statistics of each whole text are standardised and mapped to `features` cosines whose inner products approximate a Gaussian
kernel. Every partition of the labelled rows adds up its own normal equations (one matrix of fixed size), the sums are
added on the way to the driver, and one small system gives the ridge weights. A third part of the labelled rows, not fitted on, calibrates: scores
are counted on a grid of 1/2000, and pooled into the non-decreasing step function that fits labels best.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graniteleaf.llm.common import label_hash, ship, stored
from graniteleaf.llm.sums import PARTS, summed
from graniteleaf.llm.textops import Words, chunks

NAMES = ("log_words", "word_chars", "upper", "digit", "symbol", "bang", "pipe", "stop", "wide", "distinct", "same_next", "top_share", "repeat8", "lines", "dup_lines", "line_words")
GRID = 2000
_CLASS = np.zeros((256, 7), bool)
for _k, _set in enumerate((range(65, 91), range(48, 58), b"#*$%&<>", b"!", b"|", b".,;:", range(128, 256))):
    _CLASS[list(_set), _k] = True


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of NAMES for each text; an empty text has zeros."""
    out = np.zeros((len(texts), len(NAMES)))
    for a, b in chunks(texts):
        out[a:b] = _statistics(texts[a:b])
    return out


def _shares(keys: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: its distinct keys, the count of its most frequent key, and how many keys stand there twice or more."""
    order = np.lexsort((keys, doc))
    k, d = keys[order], doc[order]
    head = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])))) if len(k) else np.zeros(0, int)
    runs = np.diff(np.concatenate((head, [len(k)])))
    distinct, top, twice = np.bincount(d[head], minlength=n), np.zeros(n), np.bincount(d[head], np.where(runs > 1, runs, 0), n)
    np.maximum.at(top, d[head], runs)
    return distinct, top, twice


def _capitals(text: str) -> int:
    """Upper-case letters, one look-up a kind of character."""
    return sum(n for c, n in Counter(text).items() if c.isupper())


def _statistics(texts: list[bytes]) -> np.ndarray:
    n = len(texts)
    w = Words(texts)
    words = np.diff(w.offset)
    doc = np.repeat(np.arange(n), words)
    some = np.maximum(words, 1)
    chars = np.bincount(doc, w.end - w.start, n)
    ends = np.cumsum([len(t) + 1 for t in texts])
    starts = np.concatenate(([0], ends[:-1]))
    kinds = np.add.reduceat(_CLASS[w.data].astype(np.int32), starts, axis=0) / np.maximum(chars, 1)[:, None]
    caps = np.array([_capitals(t.decode("utf-8", "replace")) if kinds[i, 6] > 0 else 0 for i, t in enumerate(texts)]) / np.maximum(chars, 1)
    kinds[:, 0] = np.maximum(kinds[:, 0], caps)
    distinct, top, _ = _shares(w.hash, doc, n)
    same = np.bincount(doc[1:], (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1]), n) if len(doc) else np.zeros(n)
    win, off = w.shingles(8)
    _, _, twice = _shares(win, np.repeat(np.arange(n), np.diff(off)), n)
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    n_lines = np.array([len(x) for x in lines])
    dup = np.array([len(x) - len(set(x)) for x in lines])
    return np.column_stack((np.log1p(words), chars / some, kinds, distinct / some, same / some, top / some, twice / np.maximum(np.diff(off), 1), np.log1p(n_lines), dup / np.maximum(n_lines, 1), np.log1p(words / np.maximum(n_lines, 1)))) * (words > 0)[:, None]


def statistics_of(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def f(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(statistics([t.encode("utf-8", "surrogatepass") for t in batch])))

    return f(F.coalesce(text, F.lit("")))


class Model:
    """What scores a row of statistics: a few thousand numbers, sent with the task."""

    def __init__(self, features: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(len(NAMES)), np.ones(len(NAMES))
        self.w = rng.normal(0, 1 / (width * np.sqrt(len(NAMES))), (len(NAMES), features))
        self.b = rng.uniform(0, 2 * np.pi, features)
        self.weights, self.base = np.zeros(features), 0.5
        self.knots, self.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])

    def map(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        return np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.base + self.map(x) @ self.weights, -0.5, 1.5)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.values)


def isotonic(at: np.ndarray, good: np.ndarray, all_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and values of the non-decreasing fit (pool adjacent violators) to good / all at increasing places; a pool is joined at its mean place."""
    pools: list[list[float]] = []
    for x, g, n in zip(at, good, all_, strict=True):
        pools.append([x * n, g, n])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def fit(rows: DataFrame, features: int = 256, width: float = 1.0, ridge: float = 1e-4, seed: int = 11) -> Model:
    """rows(x: the statistics, y: 0.0 or 1.0, part: 'fit' or 'calibrate'). Uses every row; without rows of one kind scores stay at the share of label 1, or 0.5."""
    model = Model(features, width, seed)
    m = len(NAMES)
    fitted = rows.where("part = 'fit'")
    sums = fitted.select("y", *[F.get("x", i).alias(f"x{i}") for i in range(m)]).agg(F.count("*").alias("n"), F.sum("y").alias("y"), *[f(f"x{i}").alias(f"{f.__name__}{i}") for i in range(m) for f in (F.avg, F.stddev_pop)]).first()
    if not sums["n"]:
        model.base, model.knots, model.values = 0.5, np.array([0.0, 1.0]), np.array([0.5, 0.5])
        return model
    model.mean = np.array([sums[f"avg{i}"] for i in range(m)])
    model.scale = np.maximum(np.array([sums[f"stddev_pop{i}"] for i in range(m)]), 1e-3)
    model.base = sums["y"] / sums["n"]

    def equations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = np.zeros((features, features + 1))
        for p in batches:
            if len(p):
                z = model.map(np.stack(p["x"].to_numpy()))
                a += z.T @ np.column_stack((z, p["y"].to_numpy() - model.base))
        yield pd.DataFrame({"place": np.arange(features), "row": list(a)})

    total = summed(fitted.select("x", "y").mapInPandas(equations, PARTS))
    a = np.stack([total[i] for i in range(features)])
    model.weights = np.linalg.solve(a[:, :features] + ridge * sums["n"] * np.eye(features), a[:, features])

    @F.pandas_udf("double")
    def raw(x: pd.Series) -> pd.Series:
        return pd.Series(model.raw(np.stack(x.to_numpy()))) if len(x) else pd.Series([], dtype="float64")

    held = rows.where("part = 'calibrate'").select(F.floor(raw("x") * GRID).alias("g"), "y").groupBy("g").agg(F.sum("y").alias("good"), F.count("*").alias("n")).toPandas().sort_values("g")
    if len(held):
        model.knots, model.values = isotonic((held["g"].to_numpy() + 0.5) / GRID, held["good"].to_numpy(), held["n"].to_numpy())
    return model


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, threshold: float = 0.3, carry: bool = False) -> DataFrame:
    """Per row of docs: id_col, held_out (crc32 of the id as text mod `folds` is 0), score (0 to 1), predicted (1 if score >= threshold).

    Only the text feeds the score. Labels are learnt from rows that are not held out: the last fold calibrates, the others are
    fitted on. Labels with null quality or id are not used; a document labelled twice counts twice. Null text counts as empty; empty
    texts have all statistics 0 and are scored like any other. Without usable labels all scores are 0.5. With `carry` the
    columns of docs are kept and score, held_out and predicted added (or replaced). An empty table gives an empty table.
    """
    ship(docs.sparkSession)
    x = statistics_of(F.col(text_col)).alias("_x")
    # the texts are read once, and only numbers are shuffled; with `carry` the rows are stored with their statistics
    s = stored(docs.select(F.col(id_col).alias("_id"), x, *([F.struct("*").alias("_all")] if carry else [])), "quality-statistics")
    known = labels.where(F.col(label_col).isNotNull() & (label_hash(id_col) % folds != 0)).select(F.col(id_col).alias("_l"), F.col(label_col).cast("double").alias("y"))
    rows = s.select("_id", "_x").where(label_hash("_id") % folds != 0).join(known, F.col("_id") == F.col("_l"))
    rows = stored(rows.select(F.col("_x").alias("x"), "y", F.when(label_hash("_id") % folds == folds - 1, "calibrate").otherwise("fit").alias("part")), "quality-rows")
    model = fit(rows)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(model.score(np.stack(x.to_numpy())) if len(x) else [], dtype="float64")

    s = s.withColumn("score", score("_x"))
    new = {"held_out": label_hash("_id") % folds == 0, "score": F.col("score"), "predicted": F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int")}
    kept = [F.col("_all").getField(c).alias(c) for c in docs.columns if c not in new] if carry else [F.col("_id").alias(id_col)]
    return s.select(*kept, *[v.alias(n) for n, v in new.items()])
