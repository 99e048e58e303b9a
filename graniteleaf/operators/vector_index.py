"""A stored index of vectors: lists around k-means centres, and product-quantised codes of what is left of a vector beside its centre.

A search reads the codes of a query's nearest lists (a byte for every WIDTH entries), scores what they decode to, and takes exact scores only of the
best `depth` of each query. Centres and code books are learnt on a bounded sample by k-means whose sums are taken in the tasks; every vector is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graniteleaf.operators.retrieval import _Best, _blank, _blocks, top_k
from graniteleaf.sources.tables import ship, stored

#: Vectors that centres and code books are learnt on (about, by a threshold on a hash), and rounds of k-means.
SAMPLE, ROUNDS = 50_000, 8
#: Entries of a vector that one byte of its code stands for, and values of a byte.
WIDTH, CODES = 4, 256
#: Share of the lists that a search reads the codes of, and exact scores taken for each query: at most a tenth of the vectors.
PROBED, DEPTH = 0.75, 100
#: Candidates of a block of queries that are sent to the tasks at once.
SENT = 1 << 20


@dataclass
class Codebook:
    """centres: lists x entries; parts: for each stretch of WIDTH entries (the last may be padded) its CODES centres of residuals."""

    centres: np.ndarray
    parts: np.ndarray

    def _split(self, x: np.ndarray) -> np.ndarray:
        pad = self.parts.shape[0] * WIDTH - x.shape[1]
        return np.pad(x, ((0, 0), (0, pad))).reshape(len(x), -1, WIDTH)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lists = nearest(x[:, None], self.centres[None])[:, 0]
        return lists, nearest(self._split(x - self.centres[lists]), self.parts).astype(np.uint8)

    def decode(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        left = self.parts[np.arange(self.parts.shape[0]), codes].reshape(len(codes), -1)
        return self.centres[lists] + left[:, : self.centres.shape[1]]


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """x: rows x groups x width, centres: groups x places x width -> of each row and group the place of the nearest centre."""
    out = np.empty(x.shape[:2], np.int64)
    for g in range(x.shape[1]):
        half = (centres[g] ** 2).sum(1) / 2
        for a in range(0, len(x), 4096):
            out[a : a + 4096, g] = (x[a : a + 4096, g] @ centres[g].T - half).argmax(1)
    return out


def _k_means(sample: DataFrame, groups, start: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd's rounds for all groups at once. groups: rows x entries -> rows x groups x width; start: groups x places x width. A centre without rows stays."""
    centres = start.astype(np.float64)
    _, places, width = centres.shape

    for _ in range(rounds):

        def add(batches: Iterator[pd.DataFrame], centres=centres) -> Iterator[pd.DataFrame]:
            total, n = np.zeros((centres.shape[0] * places, width)), np.zeros(centres.shape[0] * places)
            for batch in batches:
                if len(batch):
                    x = groups(np.stack(batch["embedding"].to_numpy()).astype(np.float64))
                    at = (nearest(x, centres) + np.arange(x.shape[1]) * places).ravel()
                    np.add.at(total, at, x.reshape(-1, width))
                    n += np.bincount(at, minlength=len(n))
            met = np.flatnonzero(n)
            if len(met):
                yield pd.DataFrame({"place": met, "n": n[met], "total": list(total[met])})

        sums = sample.mapInPandas(add, "place int, n double, total array<double>").select("place", "n", F.posexplode("total").alias("i", "x"))
        for r in sums.groupBy("place", "i").agg((F.sum("x") / F.sum("n")).alias("mean")).groupBy("place").agg(F.array_sort(F.collect_list(F.struct("i", "mean"))).alias("m")).collect():
            centres[r["place"] // places, r["place"] % places] = [v["mean"] for v in r["m"]]
    return centres


def learn(vectors: DataFrame, lists: int | None = None, sample: int = SAMPLE, seed: int = 1) -> Codebook | None:
    """Centres and code books of vectors(chunk_id, embedding) of one length, without nulls; None without vectors. By default as many lists as the root of the number of vectors, 4096 at most."""
    many = vectors.count()
    if not many:
        return None
    lists = max(1, min(int(many**0.5), 4096)) if lists is None else lists
    h = F.pmod(F.xxhash64("embedding", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = stored(vectors.where(h < sample / many).select("embedding").distinct().repartition(8), "vector-sample")
    # the sample may miss tiny tables
    first = [r["embedding"] for r in some.orderBy(F.xxhash64("embedding", F.lit(seed + 1))).limit(max(lists, CODES)).collect()] or [vectors.first()["embedding"]]
    first = np.array(first, np.float64)
    centres = _k_means(some, lambda x: x[:, None], first[None, :lists])[0]
    blank = Codebook(centres, np.zeros((-(-first.shape[1] // WIDTH), 1, WIDTH)))

    def residuals(x: np.ndarray) -> np.ndarray:
        return blank._split(x - centres[nearest(x[:, None], centres[None])[:, 0]])

    start = residuals(first[:CODES]).transpose(1, 0, 2)
    return Codebook(centres.astype(np.float32), _k_means(some, residuals, start).astype(np.float32))


def build(vectors: DataFrame, path: str, lists: int | None = None, sample: int = SAMPLE) -> None:
    """Write the index of vectors(chunk_id, embedding) to path: rows/ with list, code and vector of every one, ordered by list, and book/. Null vectors are left out."""
    spark = vectors.sparkSession
    ship(spark)
    vectors = vectors.where(F.col("embedding").isNotNull()).select("chunk_id", "embedding")
    book = learn(vectors, lists, sample)
    kind = dict(vectors.dtypes)["chunk_id"]
    rows = [("centre", 0, i, [float(v) for v in c]) for i, c in enumerate(book.centres)] + [("code", g, i, [float(v) for v in c]) for g, part in enumerate(book.parts) for i, c in enumerate(part)] if book else []
    spark.createDataFrame(rows, "kind string, part int, place int, entries array<float>").coalesce(1).write.mode("overwrite").parquet(f"{path}/book")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                at, codes = book.encode(np.stack(batch["embedding"].to_numpy()).astype(np.float32))
                yield pd.DataFrame({"list": at, "chunk_id": batch["chunk_id"], "code": [c.tobytes() for c in codes], "embedding": batch["embedding"]})

    coded = vectors.mapInPandas(encode, f"list int, chunk_id {kind}, code binary, embedding array<float>")
    # a list with most vectors lies in several files
    coded.repartitionByRange("list", F.xxhash64("chunk_id")).sortWithinPartitions("list").write.mode("overwrite").parquet(f"{path}/rows")


def read_book(spark: SparkSession, path: str) -> Codebook | None:
    rows = spark.read.parquet(f"{path}/book").collect()
    if not rows:
        return None
    take = lambda kind, part: np.array([r["entries"] for r in sorted((r for r in rows if r["kind"] == kind and r["part"] == part), key=lambda r: r["place"])], np.float32)
    return Codebook(take("centre", 0), np.stack([take("code", g) for g in range(1 + max(r["part"] for r in rows if r["kind"] == "code"))]))


def search(queries: DataFrame, path: str, k: int = 10, probed: float = PROBED, depth: int = DEPTH, digits: int = 5) -> DataFrame:
    """queries(query_id, embedding) -> query_id, chunk_id, score (exact), rank of the k best that the index at path finds.

    Each query reads the codes of its nearest lists, `probed` of all, and takes exact scores of its `depth` best by code (k at least, else at most a tenth of all). Null
    query vectors find nothing; an empty index gives no rows. Queries are taken in blocks; nothing but candidates is shuffled.
    """
    spark = queries.sparkSession
    ship(spark)
    index, book = spark.read.parquet(f"{path}/rows"), read_book(spark, path)
    kinds = dict(queries.dtypes)["query_id"], dict(index.dtypes)["chunk_id"]
    found = None
    if book is not None:
        depth = max(k, min(depth, index.count() // 10))
        n_lists = max(1, round(probed * len(book.centres)))
        for rows in _blocks(queries):
            for a in range(0, len(rows), max(SENT // depth, 1)):
                part = _block(index, book, rows[a : a + max(SENT // depth, 1)], kinds, k, n_lists, depth, digits)
                found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double, rank int")
    return found


def _block(index: DataFrame, book: Codebook, rows: list, kinds: tuple[str, str], k: int, n_lists: int, depth: int, digits: int) -> DataFrame:
    ids, q = [r[0] for r in rows], np.array([r[1] for r in rows], np.float32)
    by_centre = q @ book.centres.T - (book.centres**2).sum(1) / 2
    near = np.argpartition(-by_centre, n_lists - 1, axis=1)[:, :n_lists]
    asked = [np.flatnonzero((near == c).any(1)) for c in range(len(book.centres))]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = _Best(len(q), depth, _blank(kinds[1]))
        for batch in batches:
            lists, own = batch["list"].to_numpy(), batch["chunk_id"].to_numpy()
            codes = np.frombuffer(b"".join(batch["code"]), np.uint8).reshape(len(batch), -1)
            for c in np.unique(lists):
                at, mine = asked[c], np.flatnonzero(lists == c)
                if len(at):
                    v = book.decode(lists[mine], codes[mine]).T
                    for a in range(0, len(at), 512):
                        kept.add(at[a : a + 512], (q[at[a : a + 512]] @ v).astype(np.float64), own[mine])
        yield kept.rows(ids)

    read = [int(c) for c in range(len(asked)) if len(asked[c])]
    codes = index.select("list", "chunk_id", "code")
    codes = codes if len(read) == len(asked) else codes.where(F.col("list").isin(read))
    best = top_k(codes.mapInPandas(scan, f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double"), depth, 9).select("query_id", "chunk_id")
    asked_for = index.sparkSession.createDataFrame([(i, v.tolist()) for i, v in zip(ids, q, strict=True)], f"query_id {kinds[0]}, q array<float>")
    # depth candidates a query, SENT at most
    pairs = index.select("chunk_id", "embedding").join(F.broadcast(stored(best, "vector-candidates")), "chunk_id").join(F.broadcast(asked_for), "query_id")
    dot = F.aggregate(F.zip_with("q", "embedding", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return top_k(pairs.select("query_id", "chunk_id", dot.alias("score")), k, digits)
