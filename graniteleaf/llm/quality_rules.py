"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Base rules reject what is too short or repeats itself. Beyond them, each rule compares one statistic of a document with
a cutoff. The cutoffs of all rules go together in steps, from lenient to strict (LADDER), and a stratum (language) gets one step: its
documents go if any rule rejects them there. Steps are tested on labelled documents, in order: the exact binomial upper
bound on the share of good documents that the rules of a step reject together must not exceed `max_false`, at confidence 1 - `delta`
shared among the strata (Bonferroni). The steps of a stratum are a fixed sequence that ends at the first failure, so testing
many of them costs no confidence, and what is guaranteed holds for the verdict, not for each rule apart. Of the steps
that pass, the most lenient that rejects most bad documents is taken; one that rejects none is not used. A stratum with too few labels gets no step.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graniteleaf.llm.common import WS, WS_CHARS, stored

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: rule: its statistic, over the columns of stats(), and its cutoff at each step (a document above the cutoff is rejected).
RULES = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", (0.3, 0.2, 0.12, 0.08, 0.05, 0.03, 0.02, 0.01)),
    "bangs": ("n_bangs / greatest(word_chars, 1)", (0.3, 0.2, 0.12, 0.08, 0.05, 0.03, 0.02, 0.01)),
    "capitals": ("n_capitals / greatest(word_chars, 1)", (0.8, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2)),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", (0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1)),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", (0.28, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.05)),
}
STEPS = 8
#: Largest share of good documents that the rules may reject in a stratum, and the chance that this fails in any.
MAX_FALSE, DELTA = 0.01, 0.05


def stats(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """`keep` and n_words, word_chars, n_symbols, n_bangs, n_capitals, n_lines, n_dup_lines, n_repeat_words (long) of each whole text (null: none).

    n_repeat_words are the words in windows of eight that stand twice or more in the text. Windows are compared by 64-bit
    hashes; only texts that repeat one sort theirs, and the words covered are counted from the gaps between the starts of
    repeated windows: n log n in a text's words. Each array is a column of its own step, computed once.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(f"[^{WS}]")))
    solid = F.translate(text, WS_CHARS, "")
    s = docs.select(*keep, solid.alias("_solid"), F.filter(F.split(text, f"[{WS}]+"), lambda w: w != "").alias("_words"), lines.alias("_lines"))
    n = F.size("_words")
    s = s.select(
        *keep, n.cast("long").alias("n_words"), F.length("_solid").cast("long").alias("word_chars"),
        (F.length("_solid") - F.length(F.translate("_solid", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("_solid") - F.length(F.translate("_solid", "!", ""))).cast("long").alias("n_bangs"),
        F.length(F.regexp_replace("_solid", "[^\\p{Lu}]+", "")).cast("long").alias("n_capitals"),
        F.size("_lines").cast("long").alias("n_lines"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(n > WINDOW, F.transform("_words", lambda w: F.xxhash64(w))).alias("_hashes"),
    )
    base = [*keep, "n_words", "word_chars", "n_symbols", "n_bangs", "n_capitals", "n_lines", "n_dup_lines"]
    s = s.select(*base, F.when(F.col("_hashes").isNotNull(), F.transform(F.sequence(F.lit(1), F.size("_hashes") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_hashes", i, F.lit(WINDOW))))).alias("_windows"))
    # null where no window repeats: the steps below then cost nothing
    s = s.select(*base, F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_sorted"))
    starts = F.filter("_sorted", lambda x, i: F.coalesce((F.get("_sorted", i - 1)["h"] == x["h"]) | (F.get("_sorted", i + 1)["h"] == x["h"]), F.get("_sorted", i - 1)["h"] == x["h"], F.get("_sorted", i + 1)["h"] == x["h"], F.lit(False)))
    s = s.select(*base, F.sort_array(F.transform(starts, lambda x: x["i"])).alias("_starts"))
    gaps = F.transform("_starts", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_starts", i + 1) - p, F.lit(WINDOW))))
    return s.select(*base, F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, g: a + g), F.lit(0)).cast("long").alias("n_repeat_words"))


def log_tail(n: Column, k: Column, p: float) -> Column:
    """ln P(Binomial(n, p) <= k), summed term by term in logarithms: exact however small the terms."""
    ratio = math.log(p) - math.log1p(-p)

    def step(a: Column, i: Column) -> Column:
        term = a["term"] + F.ln((n - i + 1).cast("double") / i.cast("double")) + ratio
        high = F.greatest(a["sum"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(F.least(a["sum"], term) - high))).alias("sum"))

    first = n.cast("double") * math.log1p(-p)
    return F.when(k == 0, first).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1)).cast("long")), F.struct(first.alias("term"), first.alias("sum")), step, lambda a: a["sum"]))


def first_step() -> Column:
    """The first step (1 is the most lenient) at which some rule rejects a row of stats(); STEPS + 1 if none does."""
    each = []
    for expr, cutoffs in RULES.values():
        value = F.expr(expr).cast("double")
        step = F.lit(STEPS + 1)
        for i, cut in reversed(list(enumerate(cutoffs, 1))):
            step = F.when(value > cut, i).otherwise(step)
        each.append(step)
    return F.least(*each)


def thresholds(labelled: DataFrame, stratum: str, max_false: float = MAX_FALSE, delta: float = DELTA) -> DataFrame:
    """stratum, step from labelled rows (stratum, quality, the columns of stats()): a row for each stratum that gets a step."""
    counted = labelled.select(F.col(stratum).alias("stratum"), "quality", first_step().alias("first")).groupBy("stratum", "first").agg(
        F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("g"), F.sum(F.when(F.col("quality") == 0, 1).otherwise(0)).alias("b")
    )
    # from here on a row for each stratum and step
    sums = counted.groupBy("stratum").agg(F.sum("g").alias("good"), F.map_from_entries(F.collect_list(F.struct("first", F.struct("g", "b")))).alias("at"))
    upto = lambda field: F.aggregate(F.sequence(F.lit(1), F.col("step")), F.lit(0).cast("long"), lambda a, i: a + F.coalesce(F.try_element_at("at", i)[field], F.lit(0)))
    steps = sums.withColumn("strata", F.count("*").over(Window.partitionBy())).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(STEPS)))).select("stratum", "strata", "step", "good", upto("g").alias("k"), upto("b").alias("bad"))
    # at k / n >= max_false no bound can pass, and the sum would be long
    likely = (F.col("good") > 0) & (F.col("k") < F.col("good") * max_false)
    fails = ~F.coalesce(likely & (F.when(likely, log_tail(F.col("good"), F.col("k"), max_false)) <= F.lit(math.log(delta)) - F.ln("strata")), F.lit(False))
    passed = steps.withColumn("_failed", F.max(fails.cast("int")).over(Window.partitionBy("stratum").orderBy("step"))).where("_failed = 0 AND bad > 0")
    return passed.groupBy("stratum").agg(F.max(F.struct("bad", -F.col("step"))).alias("b")).select("stratum", (-F.col("b")["col2"]).alias("step"))


def judged(docs: DataFrame, labels: DataFrame, stratum: str = "lang", id_col: str = "doc_id", text_col: str = "text", min_words: int = 20, max_repeat_percent: int = 30, max_false: float = MAX_FALSE, delta: float = DELTA) -> DataFrame:
    """Per row of docs: id_col, the statistics, base_failed, kept.

    labels(id_col, quality 0/1): rows with null quality count as unlabelled. A text counts once in a stratum, however many copies and labels it has: good if any label says so. Null
    text has no words and so fails the base rule. Null strata are a stratum of their own. Without labels only the base rule
    decides. Strata are values of a column of few values (their steps are broadcast). Extra columns of docs are not read. An empty table gives an empty table.
    """
    s = docs.select(F.col(id_col).alias("_id"), F.col(stratum).cast("string").alias("_stratum"), F.col(text_col).alias("_text"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("_same"))
    s = stored(stats(s, "_text", ("_id", "_stratum", "_same")), "rule-stats")
    known = labels.where("quality is not null").select(F.col(id_col).alias("_l"), "quality")
    # one trial a text of a stratum: copies and repeated labels are not independent
    trials = s.join(known, F.col("_id") == F.col("_l")).groupBy("_stratum", "_same").agg(F.max("quality").alias("quality"), *[F.first(c).alias(c) for c in s.columns if not c.startswith("_")])
    cut = thresholds(trials, "_stratum", max_false, delta)
    s = s.join(F.broadcast(cut.withColumnRenamed("stratum", "_s")), F.col("_stratum").eqNullSafe(F.col("_s")), "left")
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    above = F.coalesce(first_step() <= F.col("step"), F.lit(False))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return s.select(F.col("_id").alias(id_col), *names, base.alias("base_failed"), (~base & ~above).alias("kept"), "n_bangs", "n_capitals", "n_lines")
