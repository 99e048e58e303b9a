"""Ranking metrics over units, for every query, mode and k at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

METRICS = ("hit_rate", "recall", "full_recall", "precision", "mrr", "ndcg")


def topk_units(hits: DataFrame, by: list[str], k: int | Column) -> DataFrame:
    """by, unit_id, unit_rank: the units of the first k hits, each once, ranked by first appearance. The cut comes before the units are made distinct."""
    k = F.lit(k) if isinstance(k, int) else k
    first = hits.where(F.col("rank") <= k).groupBy(*by, "unit_id").agg(F.min("rank").alias("first"))
    return first.select(*by, "unit_id", F.row_number().over(Window.partitionBy(*by).orderBy("first")).alias("unit_rank"))


def metrics_at(hits: DataFrame, gold: DataFrame, ks: list[int], by: tuple[str, ...] = ()) -> DataFrame:
    """hits(by, query_id, unit_id, rank), gold(query_id, gold_units) -> by, k, query_id and the six metrics of each query with gold.

    Queries without hits count as misses; queries without gold have no row. One search at the largest k serves all ks.
    """
    keys = [*by, "k", "query_id"]
    wide = hits.withColumn("k", F.explode(F.array(*[F.lit(k) for k in sorted(set(ks))])))
    units = topk_units(wide, keys, F.col("k"))
    listed = units.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("unit_rank", "unit_id"))).alias("u"))
    grid = gold.crossJoin(F.broadcast(hits.select(*by).distinct())) if by else gold  # a row a mode or weight
    grid = grid.where(F.size("gold_units") > 0).withColumn("k", F.explode(F.array(*[F.lit(k) for k in sorted(set(ks))])))
    j = grid.join(listed, keys, "left").withColumn("u", F.coalesce(F.transform("u", lambda x: x["unit_id"]), F.expr("slice(gold_units, 1, 0)")))
    hit = F.transform("u", lambda x: F.array_contains("gold_units", x))
    n = F.size(F.filter(hit, lambda h: h)).cast("double")
    gains = F.aggregate(F.transform(hit, lambda h, i: F.when(h, F.lit(1.0) / F.log2(i + F.lit(2.0))).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.size("gold_units"), F.col("k"))), F.lit(0.0), lambda a, i: a + F.lit(1.0) / F.log2(i + F.lit(1.0)))
    place = F.array_position(hit, True)
    return j.select(
        *keys, F.when(n > 0, 1.0).otherwise(0.0).alias("hit_rate"), (n / F.size("gold_units")).alias("recall"), F.when(F.size(F.array_except("gold_units", "u")) == 0, 1.0).otherwise(0.0).alias("full_recall"),
        F.when(F.size("u") > 0, n / F.nullif(F.size("u"), F.lit(0))).otherwise(0.0).alias("precision"), F.when(place > 0, F.lit(1.0) / F.nullif(place, F.lit(0).cast("long"))).otherwise(0.0).alias("mrr"), (gains / ideal).alias("ndcg"),
    )


def citation_validity(cited: Column, retrieved: Column) -> Column:
    """Share of the cited units that were retrieved; null (not zero) if nothing was cited."""
    return F.size(F.filter(cited, lambda c: F.array_contains(retrieved, c))).cast("double") / F.nullif(F.size(cited), F.lit(0))


def mean(c: str) -> Column:
    """Nulls skipped, four digits; null over nothing."""
    return F.round(F.avg(c), 4).alias(c)


def mean_metrics(scores: DataFrame, by: list[str]) -> DataFrame:
    return scores.groupBy(*by).agg(*[mean(m) for m in METRICS])


def metrics_by_type(scores: DataFrame, types: DataFrame, by: list[str]) -> DataFrame:
    """Means of each group overall and by question type in one pass (grouping sets); type 'overall' is the whole group."""
    j = scores.join(types.select("query_id", "type"), "query_id").select(*by, "type", *METRICS)
    g = j.groupingSets([[*map(F.col, by)], [*map(F.col, by), F.col("type")]], *by, "type").agg(*[mean(m) for m in METRICS], F.grouping("type").alias("_g"))
    return g.withColumn("type", F.when(F.col("_g") == 1, "overall").otherwise(F.col("type"))).drop("_g")
