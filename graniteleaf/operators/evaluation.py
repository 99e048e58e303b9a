"""Evaluation of answers: grading, failure taxonomy, resuming, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPES = ("single_hop", "multi_hop", "unanswerable")
GRADES = ("correct", "partial", "incorrect")


def answerable(questions: DataFrame) -> DataFrame:
    return questions.where(F.size("gold_units") > 0)


def failure(type_: Column, abstained: Column, hit_rate: Column, full_recall: Column, grade: Column, strict: bool = False) -> Column:
    """The earliest cause wins. `strict` names grades that no judge gave 'unscored' instead of 'ok'."""
    c = F.when(type_ == "unanswerable", F.when(abstained, "ok").otherwise("hallucination_no_abstain")).when(F.coalesce(hit_rate, F.lit(0.0)) == 0, "retrieval_miss").when(abstained, "false_abstention")
    c = c.when((F.coalesce(full_recall, F.lit(0.0)) == 0) & (type_ == "multi_hop"), "partial_retrieval").when(grade == "incorrect", "generation_error").when(grade == "partial", "incomplete_answer")
    return (c.when(grade == "unscored", "unscored") if strict else c).otherwise("ok")


def grade_rows(rows: DataFrame) -> DataFrame:
    """rows(type, abstained, judge_grade, judge_faithfulness, judge_claims, ...) with grade, faithfulness, n_claims: refusals never reach the judge."""
    una, judged = F.col("type") == "unanswerable", ~((F.col("type") == "unanswerable") | F.col("abstained"))
    grade = F.when(una, F.when(F.col("abstained"), "correct").otherwise("incorrect")).when(F.col("abstained"), "incorrect").otherwise(F.col("judge_grade"))
    return rows.withColumns({"grade": grade, "faithfulness": F.when(judged, F.col("judge_faithfulness")), "n_claims": F.when(judged, F.col("judge_claims")).otherwise(0)}).drop("judge_grade", "judge_faithfulness", "judge_claims")


def models_from(rows: DataFrame) -> DataFrame:
    """gen_model, judge_model: the distinct names on the rows, sorted and joined; missing names read 'unknown'."""
    names = lambda c: F.coalesce(F.nullif(F.array_join(F.array_sort(F.collect_set(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown")))), " + "), F.lit("")), F.lit("unknown")).alias(c)
    return rows.agg(names("gen_model"), names("judge_model"))


def pending(questions: DataFrame, done: DataFrame, on: str = "query_id") -> DataFrame:
    return questions.join(done.select(on), on, "left_anti")


def in_question_order(rows: DataFrame, questions: DataFrame, on: str = "query_id") -> DataFrame:
    """rows with `position`: that of their question, unknown questions last."""
    return rows.join(questions.select(on, "ord"), on, "left").withColumn("position", F.coalesce("ord", F.lit(1_000_000_000))).drop("ord")


def _share(cond: Column, of: Column | None = None) -> Column:
    value = cond.cast("double")
    return F.round(F.avg(value if of is None else F.when(of, value)), 4)


def eval_summary(rows: DataFrame) -> DataFrame:
    ans, una = F.col("type") != "unanswerable", F.col("type") == "unanswerable"
    graded = ans & F.col("grade").isin(*GRADES)
    return rows.agg(
        F.count("*").alias("n"), _share(F.col("grade") == "correct", graded).alias("answer_accuracy_strict"), _share(F.col("grade").isin("correct", "partial"), graded).alias("answer_accuracy_lenient"),
        F.round(F.avg(F.when(ans, F.col("faithfulness"))), 4).alias("faithfulness"), F.round(F.avg("citation_validity"), 4).alias("citation_validity"), _share(F.col("abstained"), una).alias("correct_abstention_rate"),
        _share(F.col("abstained"), ans).alias("false_abstention_rate"), _share(~F.col("abstained"), una).alias("hallucination_rate_unanswerable"), F.round(F.avg("latency_s"), 4).alias("mean_latency_s"),
    )


def summary_by_type(rows: DataFrame) -> DataFrame:
    """n, strict accuracy and faithfulness of every type, those without rows too."""
    types = rows.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, TYPES))).alias("type"))
    g = rows.groupBy("type").agg(F.count("*").alias("n"), _share(F.col("grade") == "correct").alias("accuracy_strict"), F.round(F.avg("faithfulness"), 4).alias("faithfulness"))
    return types.join(g, "type", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def failure_modes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("failure").agg(F.count("*").alias("n"))


def coverage(questions: DataFrame, rows: DataFrame) -> DataFrame:
    """scored, total, missing (ids in question order)."""
    j = questions.join(rows.select("query_id").distinct().withColumn("there", F.lit(True)), "query_id", "left")
    missing = F.array_sort(F.collect_list(F.when(F.col("there").isNull(), F.struct("ord", "query_id"))))
    return j.agg(F.count("there").alias("scored"), F.count("*").alias("total"), missing.alias("m")).select("scored", "total", F.array_join(F.transform("m", lambda x: x["query_id"].cast("string")), ",").alias("missing"))


def external_judge_input(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """question, answer, contexts (never empty) and reference of answered, answerable rows."""
    kept = rows.where((F.col("type") != "unanswerable") & ~F.col("abstained")).select("query_id", "answer", "contexts")
    return kept.join(questions.select("query_id", "question", "reference"), "query_id").withColumn("contexts", F.when(F.size("contexts") == 0, F.array(F.lit(""))).otherwise(F.col("contexts")))


def first_questions(questions: DataFrame, n: int) -> DataFrame:
    return questions.orderBy("ord").limit(n)


def to_save(rows: DataFrame) -> DataFrame:
    """Rows as they are saved: without the passages they were answered from."""
    return rows.drop("contexts")
