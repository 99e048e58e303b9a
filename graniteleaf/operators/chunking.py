"""Structure-aware chunks: enumerated atoms, else sentences, packed greedily into a token budget. Folds over arrays, no UDF, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graniteleaf.config import DEFAULT, Settings
from graniteleaf.functions import text as T
from graniteleaf.sources.tables import stored


def _cut(items: Column, starts: Column, joiner: str) -> Column:
    """Items (an array) joined from each start (places from 1, ascending) to the next."""
    until = lambda p, s, i: F.coalesce(F.get(s, i + 1), F.size(p) + 1)
    return T.let(F.struct(items.alias("p"), starts.alias("s")), lambda x: F.transform(x["s"], lambda a, i: F.array_join(F.slice(x["p"], a, until(x["p"], x["s"], i) - a), joiner)))


def atoms(body: Column) -> Column:
    """Lines grouped so that each group begins at an enumeration marker (the first begins anyway)."""
    opens = lambda lines: F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: (i == 1) | F.rlike(F.element_at(lines, i), F.lit(T.MARKER)))
    return T.let(F.split(body, "\n"), lambda lines: _cut(lines, opens(lines), "\n"))


def pack(pieces: Column, budget: int, joiner: str) -> Column:
    """Greedy packing: a piece opens a new part if it would take the running estimate over the budget. The fold keeps only where parts begin."""
    first = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("tok"), F.lit(1).alias("i"))

    def step(a: Column, t: Column) -> Column:
        full = (a["i"] == 1) | (a["tok"] + t > budget)
        return F.struct(F.when(full, F.concat(a["starts"], F.array(a["i"]))).otherwise(a["starts"]).alias("starts"), F.when(full, t).otherwise(a["tok"] + t).alias("tok"), (a["i"] + 1).alias("i"))

    return T.let(pieces, lambda p: _cut(p, F.aggregate(F.transform(p, T.approx_tokens), first, step, lambda a: a["starts"]), joiner))


def pieces(body: Column, budget: int) -> Column:
    """Atoms within the budget as they are, longer ones as packed sentences."""
    return F.flatten(F.transform(atoms(body), lambda a: F.when(T.approx_tokens(a) <= budget, F.array(a)).otherwise(pack(T.split_sentences(a), budget, " "))))


def fold_runt(parts: Column, least: int) -> Column:
    """A last part under `least` tokens joins the one before it, over the budget if need be."""
    n = F.size(parts)
    runt = (n > 1) & (T.approx_tokens(F.try_element_at(parts, F.lit(-1))) < least)
    return F.when(runt, F.concat(F.slice(parts, F.lit(1), F.greatest(n - 2, F.lit(0))), F.array(F.concat_ws("\n", F.try_element_at(parts, F.greatest(n - 1, F.lit(1))), F.try_element_at(parts, F.lit(-1)))))).otherwise(parts)


def breadcrumb(chapter: Column, section: Column, citation: Column, part: Column, n_parts: Column) -> Column:
    none = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    head = F.concat_ws(" > ", none(chapter), none(section))
    tail = F.when(n_parts > 1, F.concat(F.lit(" (part "), part.cast("string"), F.lit(" of "), n_parts.cast("string"), F.lit(")"))).otherwise("")
    return F.concat(F.when(head != "", F.concat(F.lit("["), head, F.lit("] "))).otherwise(""), citation, tail, F.lit("\n"))


def chunk_units(units: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """units(unit_id, citation, chapter, chapter_title, section, section_title, body, ...) -> chunks, all columns of units kept. Narrow: one row in, its chunks out."""
    u = units.withColumn("_pieces", pieces(F.col("body"), settings.max_chunk_tokens))
    u = u.withColumn("_parts", pack(F.col("_pieces"), settings.max_chunk_tokens, "\n")).withColumn("_parts", fold_runt(F.col("_parts"), settings.min_chunk_tokens))
    u = u.withColumn("n_parts", F.size("_parts"))
    c = u.select(*[x for x in units.columns if x != "body"], "n_parts", F.posexplode("_parts").alias("_pos", "_body"))
    c = c.withColumns({"part": F.col("_pos") + 1, "body": T.strip(F.col("_body"))})
    c = c.withColumn("chunk_id", F.when(F.col("n_parts") == 1, F.col("unit_id")).otherwise(F.concat("unit_id", F.lit("#p"), F.col("part").cast("string"))))
    either = lambda a, b: F.when(F.coalesce(F.col(a), F.lit("")) != "", F.col(a)).otherwise(F.col(b))
    c = c.withColumn("text", F.concat(breadcrumb(either("chapter_title", "chapter"), either("section_title", "section"), F.col("citation"), F.col("part"), F.col("n_parts")), "body"))
    return c.withColumn("n_tokens", T.approx_tokens(F.col("text"))).drop("_pos", "_body")


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """metric, value: chunks, units, chunks by kind, and the order statistics sorted[0], [n // 2], [int(n * .95)], [-1] of n_tokens.

    Order statistics come from the counts of each token number, so no task sorts the corpus.
    """
    counts = stored(chunks.groupBy("kind", "n_tokens").agg(F.count("*").alias("c"), F.sum((F.col("part") == 1).cast("long")).alias("u")), "chunk-counts")  # chunked once; a row for each token number
    kinds = counts.groupBy("kind").agg(F.sum("c").alias("value")).select(F.concat(F.lit("kind:"), "kind").alias("metric"), "value")
    by = counts.groupBy("n_tokens").agg(F.sum("c").alias("c"))
    whole = by.agg(F.sum("c").alias("n"))
    units = counts.agg(F.coalesce(F.sum("u"), F.lit(0)).alias("value")).select(F.lit("units").alias("metric"), "value")  # every unit has one first part
    upto = Window.orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    ranked = by.withColumn("hi", F.sum("c").over(upto)).withColumn("lo", F.col("hi") - F.col("c")).crossJoin(F.broadcast(whole))
    picks = F.array(*[F.struct(F.lit(m).alias("m"), i.cast("long").alias("i")) for m, i in (("tokens_min", F.lit(0)), ("tokens_p50", F.floor(F.col("n") / 2)), ("tokens_p95", F.floor(F.col("n").cast("double") * F.lit(0.95))), ("tokens_max", F.col("n") - 1))])
    order = ranked.select("n_tokens", "lo", "hi", F.explode(picks).alias("p")).where("p.i >= lo and p.i < hi").select(F.col("p.m").alias("metric"), F.col("n_tokens").cast("long").alias("value"))
    return whole.select(F.lit("chunks").alias("metric"), F.coalesce("n", F.lit(0)).cast("long").alias("value")).unionByName(units).unionByName(kinds).unionByName(order)
