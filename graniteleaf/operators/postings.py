"""A stored lexical index in blocks with their highest weights, and a BM25 top k that reads only the blocks that can matter.

Chunks are numbered by length and cut into buckets of BUCKET. A block holds a term's occurrences in one bucket: gaps between places, counts, and the highest weight
that one occurrence of the term in a query adds to a chunk there. The highest weights of a query's terms bound all scores in a bucket; the
k-th best score in a query's most promising buckets bounds what others must reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from graniteleaf.config import DEFAULT, Settings
from graniteleaf.functions import text as T
from graniteleaf.operators import indexing
from graniteleaf.operators.retrieval import Asked, _Best, _blank, asked_blocks, top_k
from graniteleaf.sources.tables import ship, stored

BUCKET = 128
#: Buckets of a query that are scored first.
FIRST = 3
#: Scores are rounded to so many digits; a bound that is lower by less than that could be equal.
DIGITS, SLACK = 6, 1e-6


def build(corpus: DataFrame, path: str, settings: Settings = DEFAULT) -> None:
    """Write the index of corpus(chunk_id, text) to path: chunks/ with ids and length norms by bucket, blocks/ by term and bucket. Null and empty texts are chunks without terms."""
    lengths = stored(indexing.document_lengths(corpus), "posting-lengths")
    mean = lengths.agg(F.avg(F.when(F.col("dl") >= 0, F.col("dl"))).alias("avgdl"))
    # by length, so that weights in a bucket are alike; ranges are numbered by themselves and shifted by the sizes of earlier ones
    sorted_ = lengths.select("chunk_id", "dl").repartitionByRange("dl", "chunk_id").sortWithinPartitions("dl", "chunk_id")
    at = stored(sorted_.select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_i")), "posting-places")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    sizes = at.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    at = at.join(F.broadcast(sizes), "_p").withColumn("ord", F.col("_before") + F.col("_i")).crossJoin(F.broadcast(mean))
    norm = F.lit(settings.bm25_k1) * (F.lit(1 - settings.bm25_b) + F.lit(settings.bm25_b) * F.col("dl") / F.col("avgdl"))
    places = stored(at.select("chunk_id", F.floor(F.col("ord") / BUCKET).cast("long").alias("bucket"), (F.col("ord") % BUCKET).cast("short").alias("place"), norm.alias("norm")), "posting-buckets")
    sort = F.array_sort(F.collect_list(F.struct("place", "chunk_id", "norm")))
    places.groupBy("bucket").agg(sort.alias("c")).select("bucket", F.col("c.chunk_id").alias("ids"), F.col("c.norm").alias("norms")).write.mode("overwrite").parquet(f"{path}/chunks")
    tf = lengths.select("chunk_id", F.explode("tokens").alias("term")).groupBy("chunk_id", "term").agg(F.count("*").cast("int").alias("tf"))
    each = tf.join(places, "chunk_id").join(indexing.term_statistics(lengths, settings).select("term", "idf"), "term")
    weight = F.col("idf") * (F.col("tf") * (settings.bm25_k1 + 1)) / (F.col("tf") + F.col("norm"))
    blocks = each.groupBy("term", "bucket").agg(F.max(weight).alias("highest"), F.first("idf").alias("idf"), F.array_sort(F.collect_list(F.struct("place", "tf"))).alias("c"))
    gaps = F.transform("c.place", lambda p, i: (p - F.when(i == 0, F.lit(0).cast("short")).otherwise(F.get(F.col("c.place"), i - 1))).cast("short"))
    blocks = blocks.select("term", "bucket", "highest", "idf", gaps.alias("gaps"), F.col("c.tf").alias("counts"))
    blocks.repartitionByRange("term", "bucket").sortWithinPartitions("term", "bucket").write.mode("overwrite").parquet(f"{path}/blocks")


def _scored(wanted: DataFrame, asked: DataFrame, blocks: DataFrame, chunks: DataFrame, k: int, settings: Settings) -> DataFrame:
    """Exact scores of the k best chunks of each query in the buckets of wanted(query_id, bucket), from each task. A bucket's blocks meet once, for all queries."""
    spark = wanted.sparkSession
    kinds = dict(wanted.dtypes)["query_id"], dict(chunks.dtypes)["ids"].removeprefix("array<").removesuffix(">")
    words, buckets = asked.select("term").distinct(), wanted.groupBy("bucket").agg(F.collect_list("query_id").alias("who"))
    idf = blocks.join(words, "term", "left_semi").groupBy("term").agg(F.first("idf").alias("idf"))
    terms = stored(asked.join(idf, "term").select("query_id", "term", (F.col("times") * F.col("idf")).alias("gain")), "posting-gains")
    parts = blocks.join(words, "term", "left_semi").join(buckets.select("bucket"), "bucket", "left_semi").groupBy("bucket").agg(F.collect_list(F.struct("term", "gaps", "counts")).alias("parts"))
    rows = parts.join(buckets, "bucket").join(chunks, "bucket").select("parts", "who", "ids", "norms")
    k1 = settings.bm25_k1
    schema = f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double"
    out = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def scan(these: Asked) -> DataFrame:
        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept, number = _Best(len(these.ids), k, _blank(kinds[1])), {q: i for i, q in enumerate(these.ids)}
            for batch in batches:
                for parts, who, ids, norms in zip(*(batch.column(c) for c in ("parts", "who", "ids", "norms")), strict=True):
                    own = np.array([number[q] for q in who.as_py() if q in number], np.int64)
                    if not len(own):
                        continue
                    term, gaps, counts = parts.values.flatten()
                    many = pc.list_value_length(gaps).to_numpy(zero_copy_only=False)
                    steps = np.cumsum(pc.list_flatten(gaps).to_numpy(zero_copy_only=False).astype(np.int64))
                    before = np.concatenate([[0], steps[np.cumsum(many)[:-1] - 1]])
                    place, which = steps - np.repeat(before, many), np.repeat(these.places(term.dictionary_encode()), many)
                    tf, norm = pc.list_flatten(counts).to_numpy(zero_copy_only=False), norms.values.to_numpy(zero_copy_only=False)
                    met = which >= 0
                    factor = tf * (k1 + 1) / (tf + norm[place])
                    scores = these.scores(place[met], which[met], factor[met], len(norm), DIGITS)
                    kept.add(own, scores[own], ids.values.to_numpy(zero_copy_only=False))
            yield from pa.Table.from_pandas(kept.rows(these.ids), schema=out, preserve_index=False).to_batches()

        return rows.mapInArrow(best, schema)

    found = spark.createDataFrame([], schema)
    for these in asked_blocks(terms):
        found = found.unionByName(scan(these))
    return found


def search(queries: DataFrame, path: str, k: int = 10, settings: Settings = DEFAULT, first: int = FIRST) -> DataFrame:
    """queries(query_id, question) -> query_id, chunk_id, score, rank: the same rows as retrieval.bm25 gives for the corpus of the index at path.

    Blocks are read in two rounds: the `first` buckets of each query by their bound, then those whose bound reaches its k-th best score so far. k is at least 1. Queries
    without a known term, null ones too, and an empty index give no rows; settings are those of build().
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    ship(queries.sparkSession)
    return top_k(_search(queries, path, k, settings, first)[0], k, DIGITS)


def _search(queries: DataFrame, path: str, k: int, settings: Settings, first: int) -> tuple[DataFrame, DataFrame]:
    spark: SparkSession = queries.sparkSession
    blocks, chunks = spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/chunks")
    asked = stored(queries.select("query_id", F.explode(T.tokenize(F.col("question"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times")), "posting-asked")
    # a weight below 0 could be left out of a chunk's score: it bounds nothing
    bound = F.sum(F.col("times") * F.greatest("highest", F.lit(0.0)))
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "bucket")
    bounds = stored(blocks.select("term", "bucket", "highest").join(asked, "term").groupBy("query_id", "bucket").agg(bound.alias("bound")).withColumn("nth", F.row_number().over(order)), "posting-bounds")
    one = stored(_scored(bounds.where(F.col("nth") <= first).select("query_id", "bucket"), asked, blocks, chunks, k, settings), "posting-first")
    least = top_k(one, k, DIGITS).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    more = bounds.where(F.col("nth") > first).join(least, "query_id", "left").where(F.col("least").isNull() | (F.col("bound") + SLACK >= F.col("least"))).select("query_id", "bucket")
    two = _scored(more, asked, blocks, chunks, k, settings)
    return one.unionByName(two), bounds.groupBy("query_id").agg(F.count("*").alias("buckets")).join(more.groupBy("query_id").agg(F.count("*").alias("more")), "query_id", "left").select("query_id", "buckets", F.least(F.lit(first), F.col("buckets")).alias("first"), F.coalesce("more", F.lit(0)).alias("more"))


def buckets_read(queries: DataFrame, path: str, k: int = 10, settings: Settings = DEFAULT, first: int = FIRST) -> DataFrame:
    """query_id, buckets (with any of its terms), first and more (those that search() reads in each round)."""
    return _search(queries, path, k, settings, first)[1]
