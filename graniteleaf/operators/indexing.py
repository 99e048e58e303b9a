"""Lexical statistics and vectors as ordinary tables."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graniteleaf.config import DEFAULT, Settings
from graniteleaf.functions import text as T
from graniteleaf.functions.arrays import cut, slices, text_slices
from graniteleaf.sources.tables import ship, stored

#: The columns that an index keeps beside id, vector and text.
META = ("kind", "unit_id", "citation", "title", "chapter_title", "section_title", "part", "n_parts", "url", "n_tokens")
#: Width of the hashing encoder that stands in where no text encoder is at hand.
HASH_DIMS = 64
_LETTER = 40
#: Bytes of texts that are cut at once, and distinct tokens whose vectors are taken at once.
CUT_BYTES, COUNTED = 4 << 20, 1 << 20
#: Tokens whose document frequencies a task holds before it passes them on, and tokens in one of the rows that carry them.
HELD, CARRIED = 1 << 20, 1 << 14


def without_kind(chunks: DataFrame, kind: str) -> DataFrame:
    """Dropped before anything dear is done to them."""
    return chunks.where(F.col("kind") != kind)


def index_projection(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", "text", *META)


def l2_normalize(v: Column) -> Column:
    """Unit length in doubles; a zero vector stays zero."""

    def scaled(d: Column) -> Column:
        norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
        return F.zip_with(d, F.array_repeat(norm, F.size(d)), lambda x, n: F.when(n > 0, x / n).otherwise(x))

    return T.let(F.transform(v, lambda x: x.cast("double")), scaled)


def hit_columns(run: DataFrame, chunks: DataFrame) -> DataFrame:
    """A run (query_id, chunk_id, score, rank) with the metadata of its hits, joined after the cut: nine columns a hit; what a chunk lacks is null."""
    wanted = ("text", "kind", "unit_id", "citation", "chapter_title", "url")
    meta = chunks.select("chunk_id", *[F.col(c) if c in chunks.columns else F.lit(None).cast("string").alias(c) for c in wanted])
    run = stored(run, "hits-to-show")  # few rows: they go to the texts, which are not shuffled
    meta = meta.join(run.select("chunk_id"), "chunk_id", "left_semi")
    return run.join(meta, "chunk_id", "left").select("query_id", "chunk_id", "text", "score", "rank", "kind", "unit_id", "citation", "chapter_title", "url")


def hash_encode(c: Column) -> Column:
    """A text as L2-normalised counts of its tokens in HASH_DIMS buckets of md5: the offline stand-in for an encoder."""
    # a bucket is a letter, a text a string of letters: a count is what the string loses without a letter
    letter = lambda t: F.chr(F.conv(F.substring(F.md5(t), 1, 4), 16, 10).cast("int") % HASH_DIMS + _LETTER)
    count = lambda s, i: (F.octet_length(s) - F.octet_length(F.replace(s, F.lit(chr(_LETTER + i)), F.lit("")))).cast("double")
    counts = T.let(F.array_join(F.transform(T.tokenize(c), letter), ""), lambda s: F.array(*[count(s, i) for i in range(HASH_DIMS)]))
    return l2_normalize(counts)


def token_counts(corpus: DataFrame) -> DataFrame:
    """corpus(chunk_id, text) -> chunk_id, dl, tokens, counts: each token of a chunk once, with its count; null for null texts.

    The tokens of document_lengths(), cut in Arrow buffers: one narrow pass, and no string is made of a repeated token.
    """
    return _cut(corpus, None).drop("summed")


def asked_counts(corpus: DataFrame, words: list[str]) -> DataFrame:
    """token_counts() of `words` alone (dl counts all tokens), and in the same pass the document frequencies of all tokens: chunk_id, dl, tokens, counts, summed.

    Where `summed` is true, the row is no chunk: its counts are numbers of a task's chunks that hold its tokens, whatever the words. What leaves a task grows with the words
    that are asked for and with the vocabulary, not with the texts.
    """
    return _cut(corpus, pa.array(words, pa.string()))


class _Frequencies:
    """Document frequencies of the chunks that a task has met. HELD tokens are held at once, in Arrow."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, tokens: pa.Array, counts: np.ndarray) -> Iterator[pa.Table]:
        self.parts.append(pa.table({"t": tokens, "n": counts}))
        self.size += len(tokens)
        if self.size >= HELD:
            whole = self._summed()
            self.parts, self.size = [whole], len(whole)
            if self.size >= HELD // 2:
                yield from self.rest()

    def _summed(self) -> pa.Table:
        return pa.concat_tables(self.parts).group_by("t", use_threads=False).aggregate([("n", "sum")]).rename_columns({"t": "t", "n_sum": "n"})

    def rest(self) -> Iterator[pa.Table]:
        if self.size:
            whole = self._summed()
            self.parts, self.size = [], 0
            yield from (whole.slice(a, CARRIED) for a in range(0, len(whole), CARRIED))


def _cut(corpus: DataFrame, words: pa.Array | None) -> DataFrame:
    ship(corpus.sparkSession)
    names = ["chunk_id", "dl", "tokens", "counts", "summed"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, kind = _Frequencies(), None

        def carried(parts: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                lists = [pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), x) for x in (part["t"].combine_chunks(), part["n"].cast(pa.int32()).combine_chunks())]
                yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.int32()), *lists, pa.array([True])], names=names)

        for batch in batches:
            own, texts = batch.column("chunk_id"), batch.column("text")
            kind = own.type
            for a, ends, data in text_slices(texts, CUT_BYTES):
                upto, tokens = cut(ends, data)
                coded = tokens.dictionary_encode()
                n, dl = max(len(coded.dictionary), 1), np.diff(upto, prepend=0)
                key, counts = np.unique(np.repeat(np.arange(len(dl)) * n, dl) + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
                if words is not None:
                    yield from carried(met.add(coded.dictionary, np.bincount(key % n, minlength=len(coded.dictionary))))
                    asked = pc.is_in(coded.dictionary, value_set=words).to_numpy(zero_copy_only=False)[key % n]
                    key, counts = key[asked], counts[asked]
                at = pa.array(np.searchsorted(key, np.arange(len(dl) + 1) * n).astype(np.int32))
                none = texts.slice(a, len(dl)).is_null()
                lists = [pa.ListArray.from_arrays(at, x, mask=none) for x in (coded.dictionary.take(pa.array(key % n)), pa.array(counts.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays([own.slice(a, len(dl)), pa.array(dl.astype(np.int32), mask=none.to_numpy(zero_copy_only=False)), *lists, pa.array(np.zeros(len(dl), bool))], names=names)
        yield from carried(met.rest())

    return corpus.select("chunk_id", F.lower("text").alias("text")).mapInArrow(count, f"chunk_id {dict(corpus.dtypes)['chunk_id']}, dl int, tokens array<string>, counts array<int>, summed boolean")


def _buckets(tokens: pa.Array) -> np.ndarray:
    """The bucket of each token, as in hash_encode: from the first two bytes of its md5."""
    digests = b"".join([md5(t).digest() for t in tokens.cast(pa.binary()).to_pylist()])
    return (np.frombuffer(digests, ">u2")[::8] % HASH_DIMS).astype(np.int64)


def hash_vectors(counted: DataFrame) -> DataFrame:
    """Rows of token_counts() -> chunk_id, embedding: the vectors of hash_encode, null for null texts."""
    ship(counted.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, times, done, seen = batch.column("tokens"), pc.list_flatten(batch.column("counts")).to_numpy(zero_copy_only=False), 0, 0
            for ends, flat in slices(tokens, COUNTED):
                coded = flat.dictionary_encode()
                bucket = _buckets(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
                row = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
                v = np.bincount(row * HASH_DIMS + bucket, times[seen : seen + len(flat)], len(ends) * HASH_DIMS).astype(np.float64).reshape(-1, HASH_DIMS)
                norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
                v = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)
                at = pa.array(np.arange(len(ends) + 1, dtype=np.int32) * HASH_DIMS)
                vectors = pa.ListArray.from_arrays(at, pa.array(v.ravel()), mask=tokens.slice(done, len(ends)).is_null())
                yield pa.RecordBatch.from_arrays([batch.column("chunk_id").slice(done, len(ends)), vectors], names=["chunk_id", "embedding"])
                done, seen = done + len(ends), seen + len(flat)

    return counted.select("chunk_id", "tokens", "counts").mapInArrow(encode, f"chunk_id {dict(counted.dtypes)['chunk_id']}, embedding array<double>")


def document_lengths(corpus: DataFrame) -> DataFrame:
    """corpus(chunk_id, text) -> chunk_id, tokens, dl."""
    return corpus.select("chunk_id", T.tokenize(F.col("text")).alias("tokens")).withColumn("dl", F.size("tokens"))


def term_statistics(lengths: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """term, df, idf: Okapi weights over all chunks; a negative weight becomes the floor times the mean weight of all terms.

    A chunk sends each of its terms once (of rows with `counts` they are distinct already); the counts are summed map-side first.
    Rows of asked_counts() bring their frequencies with them.
    """
    if "summed" in lengths.columns:
        sent = lengths.where("summed").select(F.explode(F.arrays_zip("tokens", "counts")).alias("x")).select(F.col("x.tokens").alias("term"), F.col("x.counts").cast("long").alias("df"))
        return _weights(sent.where("term IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df")), lengths.where("NOT summed"), settings)
    own = F.col("tokens") if "counts" in lengths.columns else F.array_distinct("tokens")
    return _weights(lengths.select(F.explode(own).alias("term")).where("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("df")), lengths, settings)


def _weights(df: DataFrame, chunks: DataFrame, settings: Settings) -> DataFrame:
    """df(term, df), a row a term that is not null: a join on terms would filter one reading of df only; alike they are one shuffle."""
    n = chunks.agg(F.count("*").alias("n"))
    raw = df.crossJoin(F.broadcast(n)).withColumn("raw", F.ln(F.col("n") - F.col("df") + F.lit(0.5).cast("double")) - F.ln(F.col("df") + F.lit(0.5).cast("double")))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, F.lit(settings.bm25_floor) * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def lexical_index(corpus: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """term, chunk_id, weight: what one occurrence of the term in a query adds to the chunk's BM25 score.

    Written once (write_lexical_index), it leaves a query one join on its terms and one sum.
    """
    lengths = document_lengths(corpus)
    mean = lengths.agg(F.avg("dl").alias("avgdl"))
    tf = lengths.select("chunk_id", "dl", F.explode("tokens").alias("term")).groupBy("term", "chunk_id", "dl").agg(F.count("*").alias("tf"))
    k1, b = settings.bm25_k1, settings.bm25_b
    weight = F.col("idf") * (F.col("tf") * (k1 + 1)) / (F.col("tf") + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("dl") / F.col("avgdl")))
    return tf.join(term_statistics(lengths, settings), "term").crossJoin(F.broadcast(mean)).select("term", "chunk_id", weight.alias("weight"))


def write_lexical_index(postings: DataFrame, path: str) -> None:
    """Ranges of terms and chunks a file, sorted inside, so a query's terms skip most row groups, and a frequent term fills several files."""
    postings.repartitionByRange("term", "chunk_id").sortWithinPartitions("term", "chunk_id").write.mode("overwrite").parquet(path)
