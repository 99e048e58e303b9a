"""A lexical index that changes: immutable segments, tombstones and numbered manifests, and a BM25 search over what is live.

A segment holds postings (term, chunk, count, length) by term, its chunks, and how many chunks each term has. A deletion writes the dead chunks of each segment and
how many of them each term had, so that statistics of the live corpus are sums over small tables. A manifest names what is current; a new one is
created only if nobody else has taken its number, so writers do not overwrite each other and readers keep what they opened.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graniteleaf.config import DEFAULT, Settings
from graniteleaf.functions import text as T
from graniteleaf.operators import indexing
from graniteleaf.operators.retrieval import MOST_TERMS, bm25_best
from graniteleaf.sources.tables import stored


class Conflict(RuntimeError):
    """Another writer has committed since this one looked; nothing is changed, and the work can be done again."""


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    return hadoop, hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, path: str) -> dict:
    """The current manifest: version, segments and dead (names in order); version 0 where there is none."""
    hadoop, files = _files(spark, path)
    found = files.globStatus(hadoop.Path(f"{path}/manifest-*.json")) or []
    if not len(found):
        return {"version": 0, "segments": [], "dead": []}
    last = max(str(f.getPath()) for f in found)
    return json.loads(spark.read.option("wholetext", True).text(last).first()[0])


def _commit(spark: SparkSession, path: str, old: dict, segments: list[str], dead: list[str]) -> None:
    hadoop, files = _files(spark, path)
    new = {"version": old["version"] + 1, "segments": segments, "dead": dead}
    aside, to = hadoop.Path(f"{path}/_aside-{uuid.uuid4().hex}"), hadoop.Path(f"{path}/manifest-{new['version']:012}.json")
    out = files.create(aside, False)
    out.write(bytearray(json.dumps(new), "utf-8"))
    out.close()
    if files.exists(to) or not files.rename(aside, to):
        files.delete(aside, False)
        raise Conflict(f"version {new['version']} of {path} is taken")


def _table(spark: SparkSession, path: str, names: list[str], what: str, schema: str) -> DataFrame:
    """One table of all named segments or tombstones, each row with its `segment`."""
    empty = spark.createDataFrame([], f"segment string, {schema}")
    for n in names:
        part = spark.read.parquet(f"{path}/{n}/{what}")
        empty = empty.unionByName(part if "segment" in part.columns else part.withColumn("segment", F.lit(n)))
    return empty


def _postings(spark, path, m, kind):
    return _table(spark, path, m["segments"], "postings", f"term string, chunk_id {kind}, tf int, dl int")


def _chunks(spark, path, m, kind):
    """Live chunks."""
    all_ = _table(spark, path, m["segments"], "chunks", f"chunk_id {kind}, dl int")
    return all_.join(_dead(spark, path, m, kind), ["segment", "chunk_id"], "left_anti")


def _dead(spark, path, m, kind):
    return _table(spark, path, m["dead"], "chunks", f"chunk_id {kind}, dl int").select("segment", "chunk_id")


def _kind(spark, path, m) -> str:
    return dict(spark.read.parquet(f"{path}/{m['segments'][0]}/chunks").dtypes)["chunk_id"] if m["segments"] else "bigint"


def _write(spark: SparkSession, path: str, name: str, postings: DataFrame, chunks: DataFrame) -> None:
    postings.repartitionByRange("term", "chunk_id").sortWithinPartitions("term", "chunk_id").write.parquet(f"{path}/{name}/postings")
    chunks.write.parquet(f"{path}/{name}/chunks")
    spark.read.parquet(f"{path}/{name}/postings").groupBy("term").agg(F.count("*").alias("df")).write.parquet(f"{path}/{name}/terms")


def _bury(spark: SparkSession, path: str, m: dict, ids: DataFrame, kind: str) -> str | None:
    """Write the tombstones of the live chunks with these ids; None if there are none."""
    gone = stored(_chunks(spark, path, m, kind).join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi").select("segment", "chunk_id", "dl"), "segments-gone")
    if gone.isEmpty():
        return None
    name = f"dead-{uuid.uuid4().hex}"
    gone.write.parquet(f"{path}/{name}/chunks")
    _postings(spark, path, m, kind).join(gone.select("segment", "chunk_id"), ["segment", "chunk_id"], "left_semi").groupBy("term").agg(F.count("*").alias("df")).write.parquet(f"{path}/{name}/terms")
    return name


def add(corpus: DataFrame, path: str) -> int:
    """Add corpus(chunk_id, text), each id once and not null, as a new segment; chunks whose ids are there are replaced. Returns the version. Null and empty texts are chunks without terms; an empty corpus changes nothing."""
    spark = corpus.sparkSession
    m = manifest(spark, path)
    lengths = stored(indexing.document_lengths(corpus).withColumn("dl", F.greatest("dl", F.lit(0))), "segments-lengths")
    if lengths.isEmpty():
        return m["version"]
    kind = dict(corpus.dtypes)["chunk_id"]
    buried = _bury(spark, path, m, lengths, kind) if m["segments"] else None
    name = f"segment-{uuid.uuid4().hex}"
    tf = lengths.select("chunk_id", "dl", F.explode("tokens").alias("term")).groupBy("term", "chunk_id", "dl").agg(F.count("*").cast("int").alias("tf"))
    _write(spark, path, name, tf.select("term", "chunk_id", "tf", "dl"), lengths.select("chunk_id", "dl"))
    _commit(spark, path, m, [*m["segments"], name], [*m["dead"], *([buried] if buried else [])])
    return m["version"] + 1


def delete(ids: DataFrame, path: str) -> int:
    """Delete the chunks with these ids(chunk_id); unknown ids and nulls are ignored. Returns the version."""
    spark = ids.sparkSession
    m = manifest(spark, path)
    buried = _bury(spark, path, m, ids, _kind(spark, path, m)) if m["segments"] else None
    if buried is None:
        return m["version"]
    _commit(spark, path, m, m["segments"], [*m["dead"], buried])
    return m["version"] + 1


def merge(spark: SparkSession, path: str) -> int:
    """Write all live chunks as one segment without tombstones. What the old manifests name stays for readers that have it open; vacuum() removes it."""
    m = manifest(spark, path)
    if len(m["segments"]) + len(m["dead"]) < 2:
        return m["version"]
    kind, name = _kind(spark, path, m), f"segment-{uuid.uuid4().hex}"
    live = _postings(spark, path, m, kind).join(_dead(spark, path, m, kind), ["segment", "chunk_id"], "left_anti")
    _write(spark, path, name, live.select("term", "chunk_id", "tf", "dl"), _chunks(spark, path, m, kind).select("chunk_id", "dl"))
    _commit(spark, path, m, [name], [])
    return m["version"] + 1


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Remove what the current manifest does not name, the leavings of failed writers among it; not while others write or read older versions. Returns the removed names."""
    hadoop, files = _files(spark, path)
    m = manifest(spark, path)
    keep = {*m["segments"], *m["dead"], f"manifest-{m['version']:012}.json"}
    gone = sorted(n for n in (f.getPath().getName() for f in files.listStatus(hadoop.Path(path))) if n not in keep and n.startswith(("segment-", "dead-", "manifest-", "_aside-")))
    for n in gone:
        files.delete(hadoop.Path(f"{path}/{n}"), True)
    return gone


def search(queries: DataFrame, path: str, k: int = 10, settings: Settings = DEFAULT) -> DataFrame:
    """queries(query_id, question) -> query_id, chunk_id, score, rank: the rows of retrieval.bm25 over the live chunks. An index without live chunks gives none."""
    spark = queries.sparkSession
    m = manifest(spark, path)
    kind = _kind(spark, path, m)
    asked = stored(queries.select("query_id", F.explode(T.tokenize(F.col("question"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times")), "segments-asked")
    size = _chunks(spark, path, m, kind).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    df = _table(spark, path, m["segments"], "terms", "term string, df bigint").unionByName(_table(spark, path, m["dead"], "terms", "term string, df bigint").withColumn("df", -F.col("df")))
    df = df.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    half = F.lit(0.5).cast("double")
    raw = df.crossJoin(F.broadcast(size)).withColumn("raw", F.ln(F.col("n") - F.col("df") + half) - F.ln(F.col("df") + half))
    mean = raw.agg(F.avg("raw").alias("mean"))
    idf = F.when(F.col("raw") < 0, F.lit(settings.bm25_floor) * F.col("mean")).otherwise(F.col("raw"))
    terms = asked.join(raw, "term").crossJoin(F.broadcast(mean)).select("query_id", "term", (F.col("times") * idf).alias("gain"))
    postings = _postings(spark, path, m, kind)
    known = [r["term"] for r in asked.select("term").distinct().limit(MOST_TERMS + 1).collect()]
    if len(known) <= MOST_TERMS:  # known terms skip the row groups of others
        postings = postings.where(F.col("term").isin(known))
    else:
        postings = postings.join(asked.select("term").distinct(), "term", "left_semi")
    # a chunk's postings meet in its row, whatever its terms; a frequent term lies in no task of its own
    rows = postings.groupBy("segment", "chunk_id", "dl").agg(F.collect_list(F.struct("term", "tf")).alias("p"))
    live = rows.join(_dead(spark, path, m, kind), ["segment", "chunk_id"], "left_anti")
    return bm25_best(terms, live.select("chunk_id", "dl", F.col("p.term").alias("tokens"), F.col("p.tf").alias("counts")), size.first()["avgdl"], k, settings)
