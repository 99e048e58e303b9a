"""The data-shaped parts of judging: which model judges, reading its JSON, counting its verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graniteleaf import schemas
from graniteleaf.functions import text as T

GRADES = ("correct", "partial", "incorrect")


def pick_judge(generators: DataFrame, preferences: DataFrame, default: str, available: DataFrame | None = None) -> DataFrame:
    """generators(model), preferences(model, pos) -> model, judge: the first preference of another family (that is available, if
    that is known); else the default, whatever its family."""
    p = preferences.select(F.col("model").alias("judge"), "pos")
    if available is not None:
        p = p.join(available.select(F.col("model").alias("judge")), "judge", "left_semi")
    j = generators.join(p, T.model_family(F.col("model")) != T.model_family(F.col("judge")), "left")
    return j.groupBy("model").agg(F.coalesce(F.min_by("judge", "pos"), F.lit(default)).alias("judge"))


def claims_prompt(question: Column, answer: Column) -> Column:
    return F.concat(F.lit("List the separate statements of fact in this answer as a JSON array of strings.\n\nQuestion: "), question, F.lit("\n\nAnswer: "), answer)


def verify_prompt(context: Column, numbered: Column) -> Column:
    ask = "Say of each numbered statement whether the passages support it. Reply with a JSON array of {claim_index, supported, reason}.\n\nPassages:\n"
    return F.concat(F.lit(ask), context, F.lit("\n\nStatements:\n"), numbered)


def grade_prompt(question: Column, reference: Column, answer: Column) -> Column:
    ask = f"Grade the answer against the reference as one of {', '.join(GRADES)}. Reply with a JSON object of grade and reason.\n\nQuestion: "
    return F.concat(F.lit(ask), question, F.lit("\n\nReference: "), reference, F.lit("\n\nAnswer: "), answer)


def number_claims(claims: Column, most: int = 20) -> Column:
    return F.array_join(F.transform(F.slice(claims, 1, most), lambda c, i: F.concat(i.cast("string"), F.lit(". "), c)), "\n")


def verdicts(answer: Column) -> Column:
    """A judge's answer as typed verdicts; members that are no objects become null, an answer that is no list is null."""
    return F.from_json(T.json_text(answer), schemas.VERDICTS)


def faithfulness(v: Column) -> Column:
    """Supported share of the verdicts returned; null without any."""
    real = F.filter(v, lambda x: x.isNotNull())
    return F.size(F.filter(real, lambda x: F.coalesce(x["supported"], F.lit(False)))).cast("double") / F.nullif(F.size(real), F.lit(0))


def unsupported(v: Column) -> Column:
    return F.filter(v, lambda x: x.isNotNull() & ~F.coalesce(x["supported"], F.lit(False)))


def validated_grade(grade: Column) -> Column:
    return F.when(grade.isin(*GRADES), grade).otherwise("unscored")
