"""Report tables: formatted strings from metric tables of a few rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graniteleaf.functions.text import decimal3, percent

#: What each failure means, in our words.
GLOSS = (
    ("ok", "Right answer, or rightly refused."),
    ("retrieval_miss", "No gold unit among the hits."),
    ("partial_retrieval", "Several units needed, only some retrieved."),
    ("false_abstention", "Refused with the evidence at hand."),
    ("generation_error", "Evidence retrieved, wrong answer given."),
    ("incomplete_answer", "Right, but a required part is missing."),
    ("hallucination_no_abstain", "Answered what the corpus does not hold."),
)
_PERCENT, _DECIMAL = ("hit_rate", "recall", "full_recall", "precision"), ("mrr", "ndcg")


def formatted(means: DataFrame, keys: list[str], percents=_PERCENT, decimals=_DECIMAL) -> DataFrame:
    return means.select(*keys, *[percent(F.col(c)).alias(c) for c in percents], *[decimal3(F.col(c)).alias(c) for c in decimals])


def k_pivot(means: DataFrame, ks: list[int]) -> DataFrame:
    """mode, hit@k for every k, then full@k for every k."""
    p = means.groupBy("mode").pivot("k", ks).agg(F.first("hit_rate").alias("hit"), F.first("full_recall").alias("full"))
    return p.select("mode", *[percent(F.col(f"{k}_{m}")).alias(f"{m}_at_{k}") for m in ("hit", "full") for k in ks])


def ablation(means: DataFrame, default: float) -> DataFrame:
    mark = F.concat(F.col("weight").cast("string"), F.when(F.col("weight") == default, " ←default").otherwise(""))
    return formatted(means.withColumn("w", mark), ["w"], ("hit_rate", "recall", "full_recall"))


def failures(rows: DataFrame) -> DataFrame:
    """failure, n, meaning, place: by count, ties as first seen (rows.ord)."""
    from pyspark.sql.window import Window

    gloss = rows.sparkSession.createDataFrame(list(GLOSS), "failure string, meaning string")
    g = rows.groupBy("failure").agg(F.count("*").alias("n"), F.min("ord").alias("first")).join(F.broadcast(gloss), "failure", "left")
    return g.select("failure", "n", F.coalesce("meaning", F.lit("")).alias("meaning"), F.row_number().over(Window.orderBy(F.desc("n"), "first")).alias("place"))


def failing(rows: DataFrame) -> DataFrame:
    plain = lambda c, n: F.substring(F.translate(F.coalesce(F.col(c), F.lit("")), "|", "/"), 1, n)
    return rows.where("failure <> 'ok'").select("query_id", "type", "failure", plain("question", 90).alias("question"), plain("grade_reason", 150).alias("why"))


def unsupported(rows: DataFrame, most: int = 25) -> DataFrame:
    """rows(query_id, ord, unsupported_claims): the first `most` claims in question order; the report shows no more."""
    each = rows.select("query_id", "ord", F.posexplode("unsupported_claims").alias("pos", "v"))
    top = each.orderBy("ord", "pos").limit(most)
    return top.select("query_id", F.col("v.claim_index").alias("claim_index"), F.translate(F.substring(F.coalesce("v.reason", F.lit("")), 1, 120), "|", "/").alias("reason"))


def banner(coverage: DataFrame) -> DataFrame:
    """line: how many questions are scored, and which are missing; no row if none is."""
    c = coverage.where("scored < total")
    return c.select(F.concat(F.lit("Partial run: "), F.col("scored").cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit(" questions scored; missing: "), "missing").alias("line"))


def markdown(tables: list[tuple[str, DataFrame, list[str], str]]) -> DataFrame:
    """ord, line: a whole report from (title, table, columns, order column), each a heading, a header and its rows."""
    out = None
    for i, (title, df, cols, order) in enumerate(tables):
        rows = markdown_rows(df, cols, order).select(F.struct(F.lit(i).alias("t"), F.lit(1).alias("p"), F.col("ord").cast("double").alias("o")).alias("ord"), "line")
        bar = "| " + " | ".join(cols) + " |"
        head = df.sparkSession.createDataFrame([((i, 0, float(j)), x) for j, x in enumerate(("", f"## {title}", "", bar, "|" + "---|" * len(cols)))], rows.schema)
        part = head.unionByName(rows)
        out = part if out is None else out.unionByName(part)
    return out


def markdown_rows(df: DataFrame, cols: list[str], order: str) -> DataFrame:
    """ord, line: table rows of a Markdown report."""
    return df.select(F.col(order).alias("ord"), F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]), F.lit(" |")).alias("line"))
