"""Command line: run a registered query, or print the metrics of all modes, over a folder of Parquet tables."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from graniteleaf.config import DEFAULT
from graniteleaf.operators import evaluation, metrics
from graniteleaf.plans import base, queries


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="graniteleaf")
    p.add_argument("data", help="folder of the tables")
    p.add_argument("--query", help="name of a query to show instead of the evaluation", choices=sorted(queries.QUERIES))
    p.add_argument("--modes", nargs="+", default=["bm25", "dense", "hybrid"])
    p.add_argument("--ks", nargs="+", type=int, default=list(DEFAULT.ks), help="depths of the metrics")
    p.add_argument("--k", type=int, default=DEFAULT.top_k)
    p.add_argument("--limit", type=int, help="first questions only")
    p.add_argument("--rows", type=int, default=40, help="rows shown")
    a = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if a.query:
        queries.QUERIES[a.query](spark, a.data).show(a.rows, truncate=80)
        return
    asked = base.questions(spark, a.data)
    asked = evaluation.first_questions(asked, a.limit) if a.limit else asked
    ks = sorted({a.k, *a.ks})
    hits = base.all_modes(spark, a.data, max(ks)).where(F.col("mode").isin(a.modes))
    scores = metrics.metrics_at(hits, asked.select("query_id", "gold_units"), ks, ("mode",))
    metrics.mean_metrics(scores, ["mode", "k"]).orderBy("mode", "k").show(a.rows)


if __name__ == "__main__":
    main()
