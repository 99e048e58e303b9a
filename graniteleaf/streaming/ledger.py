"""The token budget on a stream of calls: sliding one-minute sums with a watermark for late events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graniteleaf.sources.tables import append_checkpoint


def sliding_spend(calls: DataFrame, seconds: int = 60, step: int = 1, late: str = "2 minutes", limit: float | None = None) -> DataFrame:
    """calls(model, ts, tokens), batch or stream -> model, start, end, spent, calls (and over, if a limit is given) of each window.

    State is one row a model and open window; the watermark closes windows, so it stays bounded.
    """
    w = F.window("ts", f"{seconds} seconds", f"{step} seconds")
    g = calls.withWatermark("ts", late).groupBy("model", w.alias("w")).agg(F.sum("tokens").alias("spent"), F.count("*").alias("calls"))
    out = g.select("model", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "spent", "calls")
    return out if limit is None else out.withColumn("over", F.col("spent") > limit)


def append_finished(rows: DataFrame, path: str, checkpoint: str, query: str = "rows"):
    """Append each finished row of a stream to a JSON-lines checkpoint; a batch that is delivered again leaves its rows once.

    A batch is written aside and renamed to a folder of path that is named after the query and the batch: that folder is the log of what is
    committed. A batch whose folder is there is ignored, and one that failed before the rename leaves nothing that read_checkpoint() sees. Two streams into one path need
    different names. On stores where a rename is no single step a crash inside it can leave part of a batch.
    """
    return rows.writeStream.foreachBatch(lambda batch, n: append_batch(batch, path, query, n)).option("checkpointLocation", checkpoint)


def append_batch(rows: DataFrame, path: str, query: str, batch: int) -> bool:
    """Commit one batch of a query; False if it was committed before."""
    spark = rows.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    done = hadoop.Path(f"{path}/{query}-{batch}")
    files = done.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(done):
        return False
    aside = f"{path}/_aside/{query}-{batch}-{uuid.uuid4().hex}"
    append_checkpoint(rows, aside)
    if not files.rename(hadoop.Path(aside), done):
        raise OSError(f"could not commit {done}")
    return True
