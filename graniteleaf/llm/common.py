"""What the training-data operators share: reading tables, durable intermediate tables, ranks without one big task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graniteleaf.sources.tables import drop_stored, shared_dir, ship, stored, table  # noqa: F401

#: White space that splits words, the same in Java, RE2 and Python.
WS = "\\x20\\x09-\\x0D"
#: The same as characters, for translate().
WS_CHARS = " \t\n\x0b\f\r"


def label_hash(key: Column | str) -> Column:
    """crc32 of the id as text, the fold rule of labelled rows; a null id counts as empty text."""
    return F.crc32(F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit("")).cast("binary"))


def ranked(df: DataFrame, group: list[str], bucket: Column, order: list[Column], weight: Column | None = None) -> DataFrame:
    """Add `rank_before`: how many rows (or how much weight) of the same group come before a row.

    `bucket` must be a non-decreasing function of the order, so each (group, bucket) is ranked by itself and
    what lies in earlier buckets comes from a small table of sums: no task ever holds a whole group, however hot.
    Null group values form a group of their own. df is read twice; hand in a stored table where that is dear.
    """
    w = F.lit(1).cast("long") if weight is None else weight.cast("long")
    df = df.withColumns({"_bucket": bucket, "_weight": w})
    keys = [F.coalesce(F.col(g).cast("string"), F.lit("\0null")).alias(f"_k{i}") for i, g in enumerate(group)]
    names = [f"_k{i}" for i in range(len(group))]
    df = df.select("*", *keys)
    sums = df.groupBy(*names, "_bucket").agg(F.sum("_weight").alias("_sum"))
    before = sums.select(*names, "_bucket", F.coalesce(F.sum("_sum").over(Window.partitionBy(*names).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("_earlier"))
    inside = Window.partitionBy(*names, "_bucket").orderBy(*order)
    own = F.coalesce(F.sum("_weight").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return df.withColumn("_own", own).join(before, [*names, "_bucket"]).withColumn("rank_before", F.col("_earlier") + F.col("_own")).drop(*names, "_bucket", "_weight", "_own", "_earlier")


#: Rows of one key that a task may hold in a join before they are dealt over several, and the most keys that can be hot.
HOT_ROWS, HOT_KEYS = 500, 100_000


def hot_keys(left: DataFrame, on: str, least: int | None = None) -> list[tuple]:
    """(key, parts) of the keys with more than `least` (HOT_ROWS) rows of left, and more than one in HOT_KEYS of them: fewer than HOT_KEYS keys."""
    most = max(HOT_ROWS if least is None else least, left.count() // HOT_KEYS)
    hot = left.where(F.col(on).isNotNull()).groupBy(on).agg(F.count("*").alias("n")).where(F.col("n") > most)
    return [tuple(r) for r in hot.select(on, F.ceil(F.col("n") / most).cast("int")).collect()]


def spread_join(left: DataFrame, right: DataFrame, on: str, how: str = "inner", hot: list[tuple] | None = None) -> DataFrame:
    """left joined with right, which holds each value of `on` at most once, without one task for all rows of a hot key.

    The rows of a hot key (hot_keys, a bounded list that is broadcast) are dealt by a salt over its parts, and its row of right is
    repeated for each part. left is read twice; hand in a stored table. Null keys match nothing, as in any join.
    """
    hot = hot_keys(left, on) if hot is None else hot
    if not hot:
        return left.join(right, on, how)
    kind = dict(left.dtypes)[on]
    many = F.broadcast(left.sparkSession.createDataFrame(hot, f"_hot {kind}, _many int"))
    parts = F.coalesce(F.col("_many"), F.lit(1))
    dealt = left.join(many, F.col(on) == F.col("_hot"), "left").withColumn("_salt", F.pmod(F.monotonically_increasing_id(), parts).cast("int")).drop("_hot", "_many")
    each = right.join(many, F.col(on) == F.col("_hot"), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_hot", "_many")
    return dealt.join(each, [on, "_salt"], how).drop("_salt")


def md5_key(seed: str, *cols: str) -> Column:
    """15 hex digits of md5 as a long from 0 to 2**60 - 1; the same in any SQL engine. Null counts as '~'."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")

