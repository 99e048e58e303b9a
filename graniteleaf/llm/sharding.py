"""Shards that all hold the mixture: proportional stratified interleaving, in DataFrame functions only.

Rows are shuffled by a seeded hash of their own values and ranked within their source; row r of n gets the fractional
rank (r + 1/2) / n. In the order of fractional ranks every stretch holds the sources in proportion, so cutting that
order into equal stretches gives shards whose counts differ by one at most and whose mixtures match.
No rank is computed in one task: hash buckets (then buckets of the fractional rank) are ranked by themselves and
shifted by the sums of earlier buckets, so a source with a third of all rows is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graniteleaf.llm.common import md5_key, ranked, stored

#: Buckets of the hash and of the fractional rank; their sums are all that one task reads of another's rows.
BUCKETS = 4096


def shard(docs: DataFrame, n_shards: int, strata: str = "source", text_col: str = "text", id_col: str = "doc_id", seed: int = 7, carry: bool = False) -> DataFrame:
    """One row for each row of docs: size (UTF-8 bytes + 8), text_crc32, law 'rows', shard 0..n_shards-1, slot (0.. in its shard), grown_shard (null).

    Counts of shards differ by one at most. Null text counts as empty, a null stratum is a stratum of its own.
    Rows alike in id, stratum and text are exchangeable, so ties and repeated rows give the same rows out in any
    run. With `carry` all columns of docs are kept beside them (those of clashing names are replaced), else only the
    id. An empty table gives an empty table; fewer rows than shards leave the last shards empty.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        *([F.struct("*").alias("_all")] if carry else []), F.col(id_col).cast("long").alias("_id"), F.col(strata).cast("string").alias("_stratum"),
        (F.octet_length(text) + 8).cast("long").alias("_size"), F.crc32(text.cast("binary")).cast("long").alias("_crc"),
    )
    rows = rows.withColumn("_hash", md5_key(f"shard-{seed}", "_id", "_crc", "_size"))
    if not carry:
        rows = stored(rows, "shard-rows")  # a few numbers a row; the texts are read once
    within = ranked(rows, ["_stratum"], F.shiftright("_hash", 48), [F.col("_hash"), F.col("_id"), F.col("_crc")])
    sizes = rows.groupBy(F.coalesce("_stratum", F.lit("\0null")).alias("_s")).agg(F.count("*").alias("_n"))
    within = within.join(sizes, F.coalesce("_stratum", F.lit("\0null")) == F.col("_s")).drop("_s")
    within = within.withColumn("_at", (F.col("rank_before") + 0.5) / F.col("_n")).drop("rank_before", "_n")
    placed = ranked(within.withColumn("_one", F.lit(0)), ["_one"], F.floor(F.col("_at") * BUCKETS).cast("long"), [F.col("_at"), F.col("_stratum"), F.col("_hash"), F.col("_id"), F.col("_crc")])
    total = rows.agg(F.count("*").alias("_total"))
    placed = placed.crossJoin(F.broadcast(total))  # one row
    k = F.lit(n_shards)
    base, more = F.floor(F.col("_total") / k).cast("long"), F.col("_total") % k  # the first `more` shards get one more
    edge = more * (base + 1)
    shard_no = F.when(F.col("rank_before") < edge, F.floor(F.col("rank_before") / (base + 1))).otherwise(more + F.floor((F.col("rank_before") - edge) / F.greatest(base, F.lit(1))))
    slot = F.when(F.col("rank_before") < edge, F.col("rank_before") % (base + 1)).otherwise((F.col("rank_before") - edge) % F.greatest(base, F.lit(1)))
    new = {"size": F.col("_size"), "text_crc32": F.col("_crc"), "law": F.lit("rows"), "shard": shard_no.cast("int"), "slot": slot.cast("long"), "grown_shard": F.lit(None).cast("int")}
    if not carry:
        return placed.select(F.col("_id").alias(id_col), *[v.alias(n) for n, v in new.items()])
    return placed.select(*[F.col("_all").getField(c).alias(c) for c in docs.columns if c not in new], *[v.alias(n) for n, v in new.items()])
