"""A text encoder that is learnt from the corpus: words by what stands around them, texts by their words.

Counts of a word beside its neighbours (hashed to CONTEXTS columns) become positive pointwise mutual information. Every task adds up its share of the columns' products,
one matrix of fixed size; the leading eigenvectors of the sum turn a word's row into its vector. A text is the mean of its words' vectors, rare words counting more, of unit length.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graniteleaf.functions import text as T
from graniteleaf.functions.arrays import slices
from graniteleaf.sources.tables import ship, stored

CONTEXTS, WINDOW, DIMS = 1024, 4, 128
#: A word is known if it stands at least LEAST times and is one in SHARE of all words at least, so there are at most SHARE of them.
LEAST, SHARE = 2, 200_000
#: Tokens that a task counts or looks up at once.
TOKENS = 1 << 17
#: Share of a word's occurrences at which it counts half.
HALF = 1e-4


def _neighbours(corpus: DataFrame) -> DataFrame:
    """term, context, n: how often a token of a hashed context stands within WINDOW of the term. TOKENS of a batch's tokens are counted at once, whatever the batch holds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ends, flat in slices(batch.column("tokens"), TOKENS):
                if not len(flat):
                    continue
                coded = flat.dictionary_encode()
                terms, at = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                own = (pd.util.hash_array(np.array(terms.to_pylist(), object)) % CONTEXTS).astype(np.int64)
                text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
                keys = []
                for d in range(1, WINDOW + 1):
                    same = np.flatnonzero(text[d:] == text[:-d])
                    a, b = at[same], at[same + d]
                    keys += [a * CONTEXTS + own[b], b * CONTEXTS + own[a]]
                key, n = np.unique(np.concatenate(keys), return_counts=True)
                yield pa.RecordBatch.from_arrays([terms.take(pa.array(key // CONTEXTS)).cast(pa.string()), pa.array((key % CONTEXTS).astype(np.int32)), pa.array(n.astype(np.int64))], ["term", "context", "n"])

    cut = corpus.select(T.tokenize(F.col("text")).alias("tokens")).where("tokens IS NOT NULL")
    return cut.mapInArrow(count, "term string, context int, n long").groupBy("term", "context").agg(F.sum("n").alias("n"))


def _added(parts: DataFrame) -> np.ndarray:
    """Sums of parts(place, row) by place."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"place": [rows["place"].iloc[0]], "row": [np.sum(np.stack(rows["row"].to_numpy()), axis=0)]})

    got = {r["place"]: r["row"] for r in parts.groupBy("place").applyInPandas(fold, "place int, row array<double>").collect()}
    return np.array([got[i] for i in range(len(got))])


def train(corpus: DataFrame, dims: int = DIMS, least: int = LEAST) -> DataFrame:
    """corpus(chunk_id, text) -> term, share (of all tokens), vector of `dims` entries: a stored table of at most SHARE words. Texts of one token teach nothing; null texts neither; an empty corpus gives no words."""
    ship(corpus.sparkSession)
    counts = corpus.select(F.explode(T.tokenize(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("many"))
    all_ = counts.agg(F.sum("many").alias("all"))
    known = stored(counts.crossJoin(F.broadcast(all_)).where((F.col("many") >= least) & (F.col("many") * SHARE >= F.col("all"))).select("term", (F.col("many") / F.col("all")).alias("share")), "encoder-terms")
    cells = stored(_neighbours(corpus).join(known, "term"), "encoder-cells")
    by_term = cells.groupBy("term").agg(F.sum("n").alias("_t"))
    by_context = cells.groupBy("context").agg(F.sum("n").alias("_c"))
    total = cells.agg(F.sum("n").alias("_n"))
    gain = F.ln(F.col("n").cast("double") * F.col("_n") / (F.col("_t").cast("double") * F.col("_c")))
    ppmi = cells.join(by_term, "term").join(F.broadcast(by_context), "context").crossJoin(F.broadcast(total)).withColumn("w", gain).where("w > 0")
    rows = stored(ppmi.groupBy("term", "share").agg(F.array_sort(F.collect_list(F.struct("context", "w"))).alias("r")).select("term", "share", F.col("r.context").alias("at"), F.col("r.w").alias("w")), "encoder-rows")

    def dense(batch: pd.DataFrame) -> np.ndarray:
        x = np.zeros((len(batch), CONTEXTS), np.float32)
        for i, (at, w) in enumerate(zip(batch["at"], batch["w"], strict=True)):
            x[i, at] = w
        return x

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((CONTEXTS, CONTEXTS))
        for batch in batches:
            for a in range(0, len(batch), 2048):
                x = dense(batch.iloc[a : a + 2048])
                total += x.T @ x
        yield pd.DataFrame({"place": np.arange(CONTEXTS), "row": list(total)})

    gram = _added(rows.mapInPandas(products, "place int, row array<double>"))
    if not len(gram):
        return rows.select("term", "share", F.col("w").alias("vector"))
    values, vectors = np.linalg.eigh(gram)
    top = np.argsort(-values)[:dims]
    turn = (vectors[:, top] / np.maximum(values[top], max(1e-9 * values.max(), 1e-12)) ** 0.25).astype(np.float32)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), 2048):
                part = batch.iloc[a : a + 2048]
                v = dense(part) @ turn
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
                yield pd.DataFrame({"term": part["term"], "share": part["share"], "vector": list(v)})

    return stored(rows.mapInPandas(project, "term string, share double, vector array<float>"), "encoder-vectors")


class _Table:
    """The words of an encoder in a worker, which keeps its last one between tasks."""

    kept: tuple[str, pa.Array, np.ndarray] | None = None


def encoder(words: DataFrame):
    """A function from a text column to its vector of unit length (all zeros without a known word; null for null), for retrieval.search(encode=...). `words` of train() are sent to the tasks: SHARE of them at most."""
    rows = words.select("term", "share", "vector").collect()
    terms = [r["term"] for r in rows]
    weights = np.array([HALF / (HALF + r["share"]) for r in rows], np.float32)
    table = np.array([r["vector"] for r in rows], np.float32).reshape(len(rows), -1 if rows else 1) * weights[:, None]
    sent, key = words.sparkSession.sparkContext.broadcast((pa.array(terms, pa.string()), table)), uuid4().hex

    @F.arrow_udf("array<double>")
    def f(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if _Table.kept is None or _Table.kept[0] != key:
            _Table.kept = key, *sent.value
        _, known, v = _Table.kept
        width = v.shape[1] if v.size else 1
        for batch in batches:
            out, done = np.zeros((len(batch), width)), 0
            for ends, flat in slices(batch, TOKENS):
                coded = flat.dictionary_encode()
                place = pc.fill_null(pc.index_in(coded.dictionary, value_set=known), -1).to_numpy(zero_copy_only=False)
                at = place[coded.indices.to_numpy(zero_copy_only=False)]
                for i, (a, b) in enumerate(zip(np.concatenate([[0], ends[:-1]]), ends, strict=True), done):
                    for x in range(a, b, TOKENS):
                        own = at[x : min(b, x + TOKENS)]
                        own = own[own >= 0]
                        if len(own):
                            out[i] += v[own].sum(0, dtype=np.float64)
                done += len(ends)
            out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
            yield pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, width, dtype=np.int32)), pa.array(out.ravel()), mask=batch.is_null())

    return lambda text: f(T.tokenize(text))


def encoded(texts: DataFrame, words: DataFrame, text_col: str = "text") -> DataFrame:
    """texts with `embedding`, as encoder() gives it."""
    encode: Column = encoder(words)(F.col(text_col))
    return texts.withColumn("embedding", encode)
