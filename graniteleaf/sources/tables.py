"""Reading and writing: Parquet tables, JSON lines with explicit schemas, append-only checkpoints, result documents."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graniteleaf import schemas


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of all executors, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_graniteleaf_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp(prefix="graniteleaf-")) / "graniteleaf.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(str(to))
    sc._graniteleaf_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or what the context has been given.

    Only in one process (a local master), where neither is set, a temporary folder is made and set; elsewhere that is an error.
    """
    got = spark.conf.get("spark.checkpoint.dir", None)
    if got:
        return got.rstrip("/")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get().rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = "file://" + tempfile.mkdtemp(prefix="graniteleaf-")
    spark.sparkContext.setCheckpointDir(made)
    return shared_dir(spark)


def _stored_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/graniteleaf/{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: lineage ends there, lost executors cost no recomputation.

    DataFrame.checkpoint() would compute its input twice (count, then write); a table is written in one pass and read by column.
    What an application has stored stays until it calls drop_stored(), as results read from it lazily.
    """
    spark = df.sparkSession
    path = f"{_stored_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession) -> None:
    """Remove all tables that this application has stored; results that still read from them are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_stored_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line, blank lines skipped; never inferred."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """Replaces what is there; nulls are kept as fields, non-ASCII text as it is."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, schemas.CHUNK)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, schemas.QUESTION)


def write_index(df: DataFrame, path: str) -> None:
    """A vector index is replaced as a whole."""
    df.write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def ensure_index(spark: SparkSession, path: str, build) -> DataFrame:
    """The index at path; where there is none, build() is written there first."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(at, "_SUCCESS")):
        write_index(build(), path)
    return read_index(spark, path)


def read_pages(spark: SparkSession, path: str, mark: str = "eli-subdivision") -> DataFrame:
    """page_id, url, html of the files under path (a landing zone that something else fills); a page without `mark` is an error, as such pages are error pages."""
    raw = spark.read.format("binaryFile").load(path)
    html = F.decode(F.col("content"), "UTF-8")
    checked = F.when(html.contains(mark), html).otherwise(F.raise_error(F.concat(F.lit("no subdivision in "), F.col("path"))))
    return raw.select(F.xxhash64("path").alias("page_id"), F.col("path").alias("url"), checked.alias("html"))


def append_checkpoint(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("ignoreNullFields", "false").json(path)


def read_checkpoint(spark: SparkSession, path: str, schema: str = schemas.EVAL_ROW) -> DataFrame:
    """Rows appended at once and rows of committed batches, which lie in folders of their own."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).json(path)


def write_document(spark: SparkSession, parts: dict[str, DataFrame], path: str) -> None:
    """One JSON document of small result tables, each under its name as a list of objects."""
    whole = None
    for name, df in parts.items():
        one = df.select(F.struct("*").alias("r")).agg(F.collect_list("r").alias(name))
        whole = one if whole is None else whole.crossJoin(one)
    whole.select(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)
