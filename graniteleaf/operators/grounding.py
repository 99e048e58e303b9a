"""What is done with hits and answers: context, prompts, citations, abstention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graniteleaf.config import DEFAULT, Settings
from graniteleaf.functions import text as T

NO_BACKEND = "No answer source is configured; these are the retrieved passages only."


def in_rank_order(hits: DataFrame, *cols: str) -> DataFrame:
    """query_id and one array per column, in the order of rank."""
    g = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", *cols))).alias("h"))
    return g.select("query_id", *[F.col("h").getField(c).alias(c) for c in cols])


def format_context(hits: DataFrame) -> DataFrame:
    """hits(query_id, rank, citation, text) -> query_id, context: '[citation]' and the text below its first line, blank line between."""
    rows = hits.select("query_id", "rank", F.concat(F.lit("["), "citation", F.lit("]\n"), T.without_first_line(F.col("text"))).alias("block"))
    return in_rank_order(rows, "block").select("query_id", F.array_join("block", "\n\n").alias("context"))


def build_prompt(context: Column, question: Column, settings: Settings = DEFAULT) -> Column:
    ask = f"Answer from the passages only and cite each in square brackets. If they hold no answer, reply {settings.abstain}.\n\nPassages:\n"
    return F.concat(F.lit(ask), context, F.lit("\n\nQuestion: "), question)


def abstained(answer: Column, settings: Settings = DEFAULT) -> Column:
    return answer.contains(settings.abstain)


def retrieved_units(hits: DataFrame) -> DataFrame:
    """query_id, retrieved_units: each unit once, at its first rank."""
    return in_rank_order(hits, "unit_id").select("query_id", F.array_distinct("unit_id").alias("retrieved_units"))


def answer_join(queries: DataFrame, answers: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """queries(query_id, question) with answers(query_id, answer, model), where there is one: answer, model, abstained, cited_units."""
    j = queries.join(answers, "query_id", "left")
    none = F.col("answer").isNull()
    return j.select(
        "query_id", "question", F.coalesce("answer", F.lit(NO_BACKEND)).alias("answer"), F.when(none, "extractive").otherwise(F.col("model")).alias("model"),
        F.coalesce(abstained(F.col("answer"), settings), F.lit(False)).alias("abstained"), F.coalesce(T.parse_citations(F.col("answer")), F.array().cast("array<string>")).alias("cited_units"),
    )


def fabricated(cited: Column, retrieved: Column) -> Column:
    return F.array_except(cited, retrieved)


def cited_hits(hits: DataFrame, answers: DataFrame) -> DataFrame:
    """hits(query_id, chunk_id, unit_id, ...) with `cited`: whether the answer (query_id, cited_units) cites the hit's unit."""
    j = hits.join(answers.select("query_id", "cited_units"), "query_id", "left")
    return j.withColumn("cited", F.coalesce(F.array_contains("cited_units", F.col("unit_id").cast("string")), F.lit(False))).drop("cited_units")


def asked_service(prompts: DataFrame, ask) -> DataFrame:
    """prompts(query_id, prompt) -> query_id, answer, by a function from prompt to answer that runs where the prompts lie (null: no answer).

    A null prompt is not asked and has no answer. What the function raises fails the query once Spark's retries are used up; a retried task asks its prompts again.
    """

    def call(batches):
        for batch in batches:
            yield batch[["query_id"]].assign(answer=[None if p is None else ask(p) for p in batch["prompt"]])

    return prompts.select("query_id", "prompt").mapInPandas(call, f"query_id {dict(prompts.dtypes)['query_id']}, answer string")


def passage_preview(text: Column, most: int = 2400) -> Column:
    body = T.without_first_line(text)
    return F.when(F.length(body) > most, F.concat(F.substring(body, 1, most), F.lit("…"))).otherwise(body)


def config_drift(running: DataFrame, measured: DataFrame) -> DataFrame:
    """running(setting, value) where measured(setting, value) has another value; nulls are values."""
    return running.alias("r").join(measured.alias("m"), "setting").where(~F.col("r.value").eqNullSafe(F.col("m.value"))).select("setting", F.col("r.value").alias("running"), F.col("m.value").alias("measured"))
