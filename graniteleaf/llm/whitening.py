"""Whitening of embeddings: the distributed centred scatter of distinct vectors, diagonalised on the driver by cyclic Jacobi rotations.

Vectors become integers (`scale` times an entry, rounded down), so copies are equal exactly and counts and sums have no error. The fit
reads a stored table of the distinct vectors three times: n and sums, the scatter of centred vectors, and the covariance of what
has been whitened, as a check. Every task adds up arrays of fixed size. Rotations go on until each off-diagonal entry is small
beside the two diagonal entries that it belongs to, which keeps small eigenvalues accurate beside large ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graniteleaf.llm.common import ship, stored
from graniteleaf.llm.sums import PARTS, summed

#: Components with less than this share of the largest eigenvalue count as without variance: rounding may be all that they hold.
RANK = 1e-9
_EPS = np.finfo(float).eps
_LOW = 20


@dataclass
class Whitening:
    """What the fit has learnt: n distinct vectors, their sums by dimension (exact), the largest entry, and eigenvalues (falling) with unit eigenvectors as columns."""

    n: int
    sums: list[int]
    largest: int
    values: np.ndarray
    vectors: np.ndarray
    identity_error: float | None = None

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums], float)

    @property
    def kept(self) -> int:
        """Components that have variance."""
        return int((self.values > RANK * self.values[0]).sum()) if len(self.values) and self.values[0] > 0 else 0

    @property
    def matrix(self) -> np.ndarray:
        """Dimensions x kept components: a centred vector times this is whitened."""
        return self.vectors[:, : self.kept] / np.sqrt(self.values[: self.kept])


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * entry) of each entry as long; null where the vector is null or an entry is null or not finite."""
    each = F.transform(vector, lambda c: c.cast("double"))
    sound = F.forall(each, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(sound, F.transform(each, lambda c: F.floor(c * float(scale))))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy())


def _totals(fit: DataFrame, dims: int) -> tuple[int, list[int], int]:
    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n, largest = [0] * dims, 0, 0
        for batch in batches:
            if len(batch):
                x = _matrix(batch["x"])
                high, low = (x >> _LOW).sum(0).tolist(), (x & ((1 << _LOW) - 1)).sum(0).tolist()  # no sum of a batch leaves 64 bits
                total = [t + (h << _LOW) + b for t, h, b in zip(total, high, low, strict=True)]
                n, largest = n + len(x), max(largest, -int(x.min()), int(x.max()))
        yield pd.DataFrame({"place": range(dims), "total": [Decimal(t) for t in total], "n": n, "largest": largest})

    got = fit.mapInPandas(add, "place int, total decimal(38,0), n long, largest long").groupBy("place").agg(F.sum("total").cast("decimal(38,0)").alias("total"), F.sum("n").alias("n"), F.max("largest").alias("largest")).collect()
    got.sort(key=lambda r: r["place"])
    return got[0]["n"], [int(r["total"]) for r in got], got[0]["largest"]


def _scatter(fit: DataFrame, dims: int, mean: np.ndarray, turn: np.ndarray | None = None) -> np.ndarray:
    """Sum over the fit list of (x - mean)' (x - mean), with `turn` applied to what is centred."""
    width = dims if turn is None else turn.shape[1]

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for batch in batches:
            if len(batch):
                z = _matrix(batch["x"]) - mean
                z = z if turn is None else z @ turn
                total += z.T @ z
        yield pd.DataFrame({"place": np.arange(width), "row": list(total)})

    got = summed(fit.mapInPandas(add, PARTS))
    return np.stack([got[i] for i in range(width)])


def jacobi(v: np.ndarray, sweeps: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix by cyclic sweeps of rotations, each of which clears one pair of off-diagonal entries.

    A pair is clear when it is below rounding beside the geometric mean of its diagonal entries, or beside RANK of the largest. A sweep without a rotation ends.
    """
    a, u = np.array(v, float), np.eye(len(v))
    floor = RANK * _EPS * np.abs(a).max(initial=0.0)
    for _ in range(sweeps):
        done = True
        for p in range(len(a) - 1):
            for q in range(p + 1, len(a)):
                off = a[p, q]
                if abs(off) <= max(_EPS * np.sqrt(abs(a[p, p] * a[q, q])), floor):
                    continue
                done = False
                half = (a[q, q] - a[p, p]) / (2 * off)
                t = (1.0 if half >= 0 else -1.0) / (abs(half) + np.hypot(half, 1.0))
                c = 1 / np.hypot(t, 1.0)
                turn = np.array([[c, t * c], [-t * c, c]])
                both = [p, q]
                a[both] = turn.T @ a[both]
                a[:, both] = a[:, both] @ turn
                a[p, q] = a[q, p] = 0.0
                u[:, both] = u[:, both] @ turn
        if done:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], u[:, order]


def fit(x: DataFrame) -> Whitening | None:
    """x(x: long array, no nulls) -> the whitening of its distinct vectors; None without vectors or dimensions. Vectors of different lengths are an error."""
    fit_list = stored(x.select("x").distinct(), "whitening-fit")
    sizes = fit_list.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if not sizes[1]:
        return None
    if sizes[0] != sizes[1]:
        raise ValueError(f"vectors of {sizes[0]} to {sizes[1]} entries: whitening needs one length")
    n, sums, largest = _totals(fit_list, sizes[1])
    found = Whitening(n, sums, largest, np.zeros(0), np.zeros((0, 0)))
    found.values, found.vectors = jacobi(_scatter(fit_list, sizes[1], found.mean) / n)
    if found.kept:
        found.identity_error = float(np.abs(_scatter(fit_list, sizes[1], found.mean, found.matrix) / n - np.eye(found.kept)).max())
    return found


def whiten(df: DataFrame, vec_col: str = "embedding", scale: int = 256, components: int | None = None) -> tuple[DataFrame, Whitening | None]:
    """df with `deviation` (sum over dimensions of (n * x - sum)**2, exact) and `whitened` (array of the first `components` projections, all by default), and the fit.

    Rows whose vector is null or holds a null or an entry that is not finite go. Copies of a vector count once in the fit and are all
    returned. Projections on components without variance (RANK) are null, as they would divide by nothing; a fit on one distinct vector has no
    others. Empty vectors have deviation 0 and no projections. Ties between eigenvalues leave their eigenvectors any orthonormal set. `deviation` is
    long where n and the entries prove that it fits, else decimal(38,0). Columns of df of the two new names are replaced, others are carried along.
    An empty table gives an empty table and no fit.
    """
    ship(df.sparkSession)
    rows = df.withColumn("_x", integers(F.col(vec_col), scale)).where("_x IS NOT NULL")
    found = fit(rows.select(F.col("_x").alias("x")))
    if found is None:
        return rows.withColumns({"deviation": F.lit(0).cast("long"), "whitened": F.array().cast("array<double>")}).drop("_x"), None
    dims = len(found.sums)
    width = dims if components is None else min(components, dims)
    narrow = (2 * found.n * found.largest) ** 2 * dims < 1 << 63
    sent = df.sparkSession.sparkContext.broadcast((found.n, found.sums, found.mean, found.matrix[:, :width]))

    @F.pandas_udf(f"deviation {'long' if narrow else 'decimal(38,0)'}, whitened array<double>")
    def turned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        n, sums, mean, matrix = sent.value
        kind = np.int64 if narrow else object
        total, blank = np.array(sums, kind), [None] * (width - matrix.shape[1])
        for batch in batches:
            if not len(batch):
                yield pd.DataFrame({"deviation": [], "whitened": []})
                continue
            x = _matrix(batch)
            far = ((n * x.astype(kind) - total) ** 2).sum(1)
            w = ((x - mean) @ matrix).tolist()
            yield pd.DataFrame({"deviation": far if narrow else [Decimal(int(v)) for v in far], "whitened": [r + blank for r in w] if blank else w})

    out = rows.withColumn("_r", turned("_x"))
    return out.withColumns({"deviation": F.col("_r.deviation"), "whitened": F.col("_r.whitened")}).drop("_x", "_r"), found


def components(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256, first: int = 4) -> DataFrame:
    """A row for each row of whiten() and each of its first components: id_col, component (from 1), n, deviation, whitened, explained, identity_error.

    explained is the eigenvalue's share of the trace (null where that is 0), identity_error the largest entry of the covariance of all whitened components over the fit list, less the
    identity (null where no component has variance). Null ids stay null. Empty vectors and tables give no rows.
    """
    rows, found = whiten(df.select(F.col(id_col).alias("_id"), F.col(vec_col).alias("_v")), "_v", scale, first)
    share = [] if found is None or not found.values.sum() > 0 else (found.values[:first] / found.values.sum()).tolist()
    out = rows.select(F.col("_id").alias(id_col), "deviation", F.posexplode("whitened").alias("_p", "whitened"))
    return out.select(
        id_col, (F.col("_p") + 1).alias("component"), F.lit(found.n if found else 0).cast("long").alias("n"), "deviation", "whitened",
        F.get(F.lit(share) if share else F.array().cast("array<double>"), F.col("_p")).alias("explained"), F.lit(found.identity_error if found else None).cast("double").alias("identity_error"),
    )
