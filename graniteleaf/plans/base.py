"""The driver's tables as retrieval inputs: corpus, questions with gold, hits, answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graniteleaf.config import DEFAULT
from graniteleaf.functions import text as T
from graniteleaf.operators import evaluation, grounding, indexing, matching, metrics, retrieval
from graniteleaf.operators.judging import validated_grade
from graniteleaf.sources.tables import stored, table

#: Sources whose documents count as the weighted kind.
WEIGHTED_SOURCES = ("src0", "src1", "src2", "src3", "src4")
K, POOL = DEFAULT.top_k, DEFAULT.pool
BASE_URL = "https://example.org/corpus"


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """chunk_id, kind, text: a document is a chunk."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.when(F.col("source").isin(*WEIGHTED_SOURCES), "recital").otherwise("article").alias("kind"), "text")


def asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def questions(spark: SparkSession, d: str) -> DataFrame:
    """query_id, ord, question, gold_units (documents that hold the question's text), type, reference.

    The questions are the stated query set; documents are read once for all of them.
    """
    q = asked(spark, d)
    held = matching.containing(corpus(spark, d).select(F.col("chunk_id").alias("text_id"), "text"), q.select(F.col("query_id").alias("pattern_id"), F.col("question").alias("pattern")))
    gold = stored(held.groupBy(F.col("pattern_id").alias("query_id")).agg(F.array_sort(F.collect_list("text_id")).alias("g")), "gold")
    q = q.join(gold, "query_id", "left").withColumn("gold_units", F.coalesce("g", F.array().cast("array<bigint>"))).drop("g")
    n = F.size("gold_units")
    return q.withColumns({"ord": F.col("query_id"), "type": F.when(n == 0, "unanswerable").when(n == 1, "single_hop").otherwise("multi_hop"), "reference": F.concat(F.lit("ref "), F.col("query_id").cast("string"))})


def listed(spark: SparkSession, d: str) -> DataFrame:
    """query_id, ord: what needs no gold."""
    return asked(spark, d).select("query_id", F.col("query_id").alias("ord"))


def runs(spark: SparkSession, d: str, depth: int = POOL) -> dict[str, DataFrame]:
    c, q = corpus(spark, d), asked(spark, d)
    counted = stored(indexing.token_counts(c), "tokens")  # cut once for both
    return {m: stored(retrieval.search(q, c, depth, m, counted=counted), f"run-{m}") for m in ("bm25", "dense")}  # searched once, whatever reads them


def bm25_hits(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    return stored(retrieval.search(asked(spark, d), corpus(spark, d), k, "bm25").withColumn("unit_id", F.col("chunk_id")), "hits")


def all_modes(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    """mode, query_id, unit_id, rank of the three modes, the two legs searched once."""
    r = runs(spark, d)
    h = retrieval.fused(r, corpus(spark, d).select("chunk_id", "kind"), k, [DEFAULT.kind_weight])
    parts = [x.where(F.col("rank") <= k).select(F.lit(m).alias("mode"), "query_id", F.col("chunk_id").alias("unit_id"), "rank") for m, x in (("bm25", r["bm25"]), ("dense", r["dense"]), ("hybrid", h))]
    return stored(parts[0].unionByName(parts[1]).unionByName(parts[2]), "modes")


def answers(spark: SparkSession, d: str) -> DataFrame:
    """Stand-in answers, judgements and latencies, from the question's number; every seventh question has no answer."""
    i = F.col("query_id")
    n = lambda m: (i % m).cast("int")
    return asked(spark, d).where(n(7) != 6).select(
        "query_id", F.when(n(5) == 0, DEFAULT.abstain).otherwise(F.concat(F.lit("As in [Article "), i.cast("string"), F.lit(" - x] and 【ANNEX III】, [Recital ("), n(4).cast("string"), F.lit(")]; again [Article "), i.cast("string"), F.lit("].")).alias("a")).alias("answer"),
        F.concat(F.lit("vendor"), n(3).cast("string"), F.lit("/model")).alias("model"), F.element_at(F.array(*map(F.lit, ("correct", "partial", "incorrect", "odd"))), n(4) + 1).alias("judge_raw"),
        F.concat(F.lit('[{"claim_index":0,"supported":true,"reason":"a|b"},{"claim_index":1,"supported":'), F.when(n(3) == 0, "true").otherwise("false"), F.lit(',"reason":"no passage "}]')).alias("verdict_json"),
        (n(10).cast("double") / 4).alias("latency_s"),
    )


def eval_rows(spark: SparkSession, d: str) -> DataFrame:
    """One row for each answered question: answer, gold, BM25 hits at K, judgement, failure."""
    from graniteleaf.operators import judging

    q, hits = questions(spark, d), bm25_hits(spark, d, K)
    scores = metrics.metrics_at(hits, q.select("query_id", "gold_units"), [K]).drop("k")
    got = grounding.in_rank_order(hits, "unit_id").select("query_id", F.transform(F.array_distinct("unit_id"), lambda u: F.concat(F.lit("art_"), u.cast("string"))).alias("retrieved_units"))
    r = q.join(answers(spark, d), "query_id").join(scores, "query_id", "left").join(got, "query_id", "left")
    r = r.withColumns({"abstained": grounding.abstained(F.col("answer")), "cited_units": T.parse_citations(F.col("answer")), "v": judging.verdicts(F.col("verdict_json")), "retrieved_units": F.coalesce("retrieved_units", F.array().cast("array<string>"))})
    r = r.withColumns({"judge_grade": validated_grade(F.col("judge_raw")), "judge_faithfulness": judging.faithfulness(F.col("v")), "judge_claims": F.size("v"), "citation_validity": metrics.citation_validity(F.col("cited_units"), F.col("retrieved_units"))})
    r = evaluation.grade_rows(r).withColumn("unsupported_claims", judging.unsupported(F.col("v")))
    r = r.withColumn("failure", evaluation.failure(F.col("type"), F.col("abstained"), F.col("hit_rate"), F.col("full_recall"), F.col("grade")))
    return r.withColumns({"gen_model": F.col("model"), "judge_model": F.when(F.col("query_id") % 2 == 0, "judge/a"), "grade_reason": F.concat(F.lit("because|"), "judge_raw")}).drop("v", "verdict_json", "model", "judge_raw")


def units(spark: SparkSession, d: str) -> DataFrame:
    """Documents as units to chunk."""
    return table(spark, d, "documents").select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("unit_id"), F.when(F.col("source").isin(*WEIGHTED_SOURCES), "recital").otherwise("article").alias("kind"), F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("citation"),
        F.lit("").alias("title"), F.col("source").alias("chapter"), F.lit("").alias("chapter_title"), F.col("lang").alias("section"), F.lit("").alias("section_title"), F.concat(F.lit(BASE_URL + "#doc_"), F.col("doc_id").cast("string")).alias("url"), F.col("text").alias("body"),
    )


def ledger(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", F.col("user_id").alias("model"), "ts", F.floor(F.abs("value")).cast("long").alias("tokens"), F.col("ts").alias("ts2"))
