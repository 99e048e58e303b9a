"""Sums of arrays of fixed size over all tasks, folded as they stream in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = "place int, row array<double>"
#: Tasks of the first level and of the second, at most.
WIDE, NARROW = 1024, 16


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for place, row in zip(batch["place"].tolist(), batch["row"], strict=True):
            if place in total:
                total[place] += row
            else:
                total[place] = np.array(row)
    if total:
        yield pd.DataFrame({"place": list(total), "row": list(total.values())})


def summed(parts: DataFrame) -> dict[int, np.ndarray]:
    """parts(PARTS), a row of each place from every task -> the sum of each place.

    Tasks are dealt to at most WIDE folds that each hold one running sum a place, and what these leave is folded place
    by place: memory is that of one set of places however many tasks there were. No rows give no places.
    """
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = parts.withColumn("_by", F.spark_partition_id() % WIDE).repartition(min(WIDE, n), "_by").select("place", "row").mapInPandas(_fold, PARTS)
    last = first.repartition(min(NARROW, n), "place").mapInPandas(_fold, PARTS)
    return {r["place"]: np.array(r["row"]) for r in last.collect()}
