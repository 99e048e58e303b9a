"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

The mixture has 2**18 slots. Each source's documents, in a seeded shuffled order, form one stream of words, cut into
blocks of total / 2**18 words (to within one word). Slot k is the van der Corput point bit_reverse(k) / 2**18, mapped
through the cumulative target shares to a source; the slots of a source are ranked and the j-th takes block j of its
stream, beginning anew at its end (at most `repeats` times). As every van der Corput point occurs once, a source gets
its share of slots to within one, and every stretch of slots holds the shares to within a few. A source of fewer than FINE
blocks takes finer ones, on a grid of 2**bits points of its own (block and slot are total / 2**bits words there), so that its
taken words too come within a FINE-th of its size to its target; its slots stand among the 2**18 by the same points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graniteleaf.llm.common import WS, md5_key, ranked, stored

#: log2 of the slots, for sources whose size and target are FINE blocks and more; others have as many bits more as give both FINE blocks.
BITS = 18
FINE = 64
SEED = "mix-1"


def n_words(text: Column) -> Column:
    """Number of runs without ASCII white space; null and blank texts have none."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), f"^[{WS}]+|[{WS}]+$", "")
    return F.when(bare == "", 0).otherwise(F.regexp_count(bare, F.lit(f"[{WS}]+")) + 1).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), repeats: int = 3) -> DataFrame:
    """sizes(source, source_size) with weight, target, lo, hi, bits: the targets, and the slots lo <= v < hi of each source, of 2**bits.

    Weights go to the sources in code point order, null last, and repeat. Targets share the sum of all sizes; one
    above `repeats` times its source's size stops there and its excess goes to the others by weight. That ends at
    least(repeats * size, level * weight) with one level, the largest of (total - capped sizes) / (other weights)
    over the sources in the order of size / weight. One row a source: the windows below hold sources, never documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pattern = F.array(*[F.lit(w) for w in weights])
    s = sizes.withColumn("weight", F.element_at(pattern, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long"))
    s = s.withColumns({"_cap": F.col("source_size") * repeats, "_total": F.sum("source_size").over(Window.partitionBy())})
    full = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    s = s.withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).cast("double") / F.sum("weight").over(full.rowsBetween(0, Window.unboundedFollowing)).cast("double"))
    s = s.withColumn("target", F.least(F.col("_cap").cast("double"), F.max("_level").over(Window.partitionBy()) * F.col("weight")))
    finer = F.ceil(F.log2(F.col("_total").cast("double") * FINE / (F.least(F.col("source_size").cast("double"), F.col("target")) * 2**BITS)))
    s = s.withColumn("bits", F.when(F.col("source_size") > 0, F.greatest(finer, F.lit(0))).otherwise(0).cast("int") + BITS)
    s = s.withColumn("_upto", F.sum("target").over(by_name.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.withColumn("_from", F.coalesce(F.lag("_upto").over(by_name), F.lit(0.0)))

    def edge(upto: Column) -> Column:
        return F.when(F.col("_total") > 0, F.least(F.floor(upto / F.col("_total") * _points(F.col("bits")).cast("double") + 0.5), _points(F.col("bits")))).otherwise(0).cast("long")

    return s.select("source", "source_size", "weight", "target", edge(F.col("_from")).alias("lo"), edge(F.col("_upto")).alias("hi"), "bits", F.col("_total").alias("total"))


def _points(bits: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bits)


def block_of(place: Column, total: Column, bits: Column) -> Column:
    """The block that holds the word at a place of its source's stream: the largest j with floor(j * total / 2**bits) <= place."""
    return F.when(total > 0, _div((place + 1) * _points(bits) - 1, F.greatest(total, F.lit(1)))).otherwise(0).cast("long")


def _div(a: Column, b: Column) -> Column:
    """Whole quotient of non-negative longs, without going through doubles."""
    return F.call_function("div", a, b)


def block_start(block: Column, total: Column, bits: Column) -> Column:
    """floor(block * total / 2**bits), in halves as block * total may exceed a long for many small blocks."""
    n = _points(bits)
    return block * _div(total, n) + _div(block * (total % n), n)


def schedule(plan: DataFrame, repeats: int = 3) -> DataFrame:
    """slot, source, block, epoch of all slots (at most 2**18 rows, and 3 * 2 * FINE + 1 of each source of finer blocks): the order in which blocks are read.

    A source that rounding gave one slot above `repeats` times its blocks leaves that slot empty.
    """
    v = plan.where("hi > lo").select("source", "total", "source_size", "bits", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("_v"))
    turned = F.reverse(F.lpad(F.bin("_v"), F.col("bits"), F.lit("0")))
    v = v.withColumn("_at", F.conv(turned, 2, 10).cast("long")).withColumn("slot", _div(F.col("_at"), _points(F.col("bits") - BITS)))
    j = F.row_number().over(Window.partitionBy("source").orderBy("_at")).cast("long") - 1
    blocks = block_of(F.col("source_size") - 1, F.col("total"), F.col("bits")) + 1
    v = v.withColumns({"_j": j, "_blocks": blocks})
    return v.where(F.col("_j") < F.col("_blocks") * repeats).select("slot", "source", (F.col("_j") % F.col("_blocks")).alias("block"), _div(F.col("_j"), F.col("_blocks")).alias("epoch"))


def placed(docs: DataFrame, plan: DataFrame, id_col: str, source_col: str) -> DataFrame:
    """docs(id, source, size, ...) with source_size, target, total, bits and `first`, its first word's place in the stream of its source."""
    rows = docs.withColumn("_h", md5_key(SEED, id_col, "size"))
    rows = ranked(rows, [source_col], F.shiftright("_h", 48), [F.col("_h"), F.col(id_col), F.col("size")], F.col("size")).withColumnRenamed("rank_before", "first")
    p = plan.select(F.col("source").alias("_s"), "source_size", "target", "total", "bits")
    return rows.join(p, F.col(source_col).eqNullSafe(F.col("_s"))).drop("_s", "_h")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), repeats: int = 3) -> DataFrame:
    """One row for each row of docs: id, source, size (words), source_size, target (of its source), taken (words the mix takes, repeats counted).

    Null text has size 0; such documents, and sources of size 0, take nothing. Null sources are one source, the last.
    Documents alike in id and size are exchangeable, so ties and repeated rows give the same rows in every run. Extra
    columns of docs are not read. An empty table gives an empty table.
    """
    rows = stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size")), "mix-rows")
    plan = stored(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeats), "mix-plan")
    at = placed(rows, plan, "doc_id", "source")
    total, bits = F.col("total"), F.col("bits")
    pieces = at.withColumn("block", F.explode(F.when(F.col("size") > 0, F.sequence(block_of(F.col("first"), total, bits), block_of(F.col("first") + F.col("size") - 1, total, bits))).otherwise(F.array(F.lit(-1).cast("long")))))
    reads = schedule(plan, repeats).groupBy(F.col("source").alias("_s"), F.col("block").alias("_b")).agg(F.count("*").alias("_reads"))
    from_, to = F.greatest(F.col("first"), block_start(F.col("block"), total, bits)), F.least(F.col("first") + F.col("size"), block_start(F.col("block") + 1, total, bits))
    joined = pieces.join(reads, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")), "left")
    words = F.coalesce(F.greatest(to - from_, F.lit(0)) * F.col("_reads"), F.lit(0))
    # `first` tells repeated rows apart; rows of size 0 may share one, and are counted out again
    grouped = joined.groupBy("doc_id", "source", "size", "source_size", "target", "first").agg(F.sum(words).cast("long").alias("taken"), F.when(F.first("size") == 0, F.count("*")).otherwise(1).cast("int").alias("_rows"))
    return grouped.withColumn("_r", F.explode(F.sequence(F.lit(1), F.col("_rows")))).drop("_rows", "_r", "first")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), repeats: int = 3) -> DataFrame:
    """The mixture in whole documents, with the columns of docs: a document stands as often as the schedule reads the block with its first word.

    A document without words is read with the block at its place. Nulls, ties, repeated rows and empty tables as in mix().
    """
    rows = docs.select(F.struct("*").alias("_all"), F.col(id_col).cast("long").alias("_id"), F.col(source_col).cast("string").alias("_source"), n_words(F.col(text_col)).alias("size"))
    plan = stored(targets(rows.groupBy(F.col("_source").alias("source")).agg(F.sum("size").alias("source_size")), weights, repeats), "mix-plan")
    at = placed(rows, plan, "_id", "_source")
    at = at.withColumn("_block", block_of(F.least(F.col("first"), F.greatest(F.col("source_size") - 1, F.lit(0))), F.col("total"), F.col("bits")))
    reads = schedule(plan, repeats).groupBy(F.col("source").alias("_s"), F.col("block").alias("_b")).agg(F.count("*").cast("int").alias("_reads"))
    joined = at.join(reads, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b")))
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_reads")))).select(*[F.col("_all").getField(c).alias(c) for c in docs.columns])
