"""Secret scans: candidates by pattern, false positives removed by a random forest. DataFrame functions and Spark ML only.

A candidate is a word of at least eight characters with a digit in it, one of a well-known key format, the first line of a private
key, or any value given to a credential word, with blanks around the assignment sign or without. The forest sees its
length, the transitions between character classes, how much of it dictionary words cover, its path, and how its neighbouring
words look. The dictionary is counted over all documents. The forest is trained from labelled findings. Where no
reviewed findings exist, weak_labels() takes them from evidence that the forest is not shown: the credential word before a value, the
fixed prefix of a key format, the filler words around a placeholder. So the forest learns what values of that kind look like, drops
values that do not (`token = "see the next page"`), and finds ones that stand without such a word. A fifth of the findings, by
hash, is held out of the training; held_out_report() counts how the forest does on them.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graniteleaf.llm.common import WS, spread_join, stored

CREDENTIAL = "(?i)(?:password|passwd|pwd|secret|token|api_?key|access_?key|auth)"
#: Public formats of well-known keys (fixed values).
KNOWN = "(?:AKIA|ASIA)[0-9A-Z]{12,}|gh[pousr]_[A-Za-z0-9]{20,}|sk[-_][A-Za-z0-9_-]{16,}|xox[a-z]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{10,}[.]"
_FILLER = "example|sample|dummy|placeholder|changeme|test|fake"
#: In the value itself anywhere (AKIA...EXAMPLE), in the words around it as whole words only (not in latest).
FILLED, PLACEHOLDER = f"(?i){_FILLER}|xxxx", f"(?i)(?<![\\p{{L}}0-9])(?:{_FILLER})(?![\\p{{L}}0-9])|xxxx"
PATH = "(?i)test|example|sample|fixture|mock|doc|spec"
#: The words that follow -----BEGIN in the first line of a private key (fixed values).
PEM, _PEM_KINDS = "-----BEGIN", ("PRIVATE", "RSA", "EC", "DSA", "OPENSSH", "ENCRYPTED", "PGP")
#: What the forest sees: nothing that weak_labels() looks at.
FEATURES = ("length", "digits", "uppers", "lowers", "others", "hex", "distinct", "letter_digit", "digit_letter", "lower_upper", "upper_lower", "covered", "near_words", "near_digits", "path_test", "path_depth")
#: Evidence for weak_labels(), kept beside the features.
EVIDENCE = ("told", "known", "placeholder")
#: Labelled candidates that the forest is trained on (about; those of least hash), documents a dictionary word must stand in, and one in HELD_OUT findings is not trained on.
TRAIN_ROWS, DICTIONARY_DOCS, HELD_OUT = 200_000, 5, 5


def dictionary(docs: DataFrame, text_col: str = "text", min_docs: int = DICTIONARY_DOCS) -> DataFrame:
    """word: runs of three or more letters, as whole words in lower case, that stand in at least min_docs documents. Texts and words of any length are taken whole; null texts have none."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), "[^\\p{L}0-9]+"), lambda w: (F.length(w) >= 3) & ~F.rlike(w, F.lit("[0-9]")))
    return docs.select(F.explode(F.array_distinct(words)).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("word")


def _count(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern)).cast("double")


def _given(word: Column, last: Column, before: Column) -> Column:
    """The word is given to a credential word that stands before it: `password: x`, `password = x`, `password =x`. `last` is the word before, `before` the two before."""
    sign_first = F.rlike(last, F.lit("[:=]>?[\"'(]*$")) & F.rlike(before, F.lit(f"{CREDENTIAL}[\"')\\]]*[ ]?[:=]+>?[\"'(]*$"))
    return F.coalesce(sign_first | (F.rlike(word, F.lit("^[:=]+[^:=]")) & F.rlike(last, F.lit(f"{CREDENTIAL}[\"')\\]]*$"))), F.lit(False))


def candidates(docs: DataFrame, words: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """id, position (of the word in its text, from 0), finding, FEATURES and EVIDENCE, one row a candidate.

    A private key in lines counts once, at the word that opens it, with the rest of that line as its finding. Very long texts are cut to
    words within their row; words of any length are taken whole.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    likely = docs.where(F.rlike(text, F.lit(f"[0-9]|{KNOWN}|{PEM}|{CREDENTIAL}[^\\p{{L}}]*[:=]"))).select(F.col(id_col).alias("id"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), F.filter(F.split(text, f"[{WS}]+"), lambda w: w != "").alias("w"))

    def wanted(w: Column, i: Column) -> Column:
        given = _given(w, F.get("w", i - 1), F.concat_ws(" ", F.get("w", i - 2), F.get("w", i - 1))) & F.rlike(w, F.lit("[^\"':=>({\\[]"))
        return given | (w.startswith("-----BEGIN") & F.coalesce(F.get("w", i + 1).isin(*_PEM_KINDS), F.lit(False))) | ((F.length(w) >= 8) & F.rlike(w, F.lit("[0-9]")) & F.rlike(w, F.lit("[A-Za-z0-9+/_=-]{8,}"))) | F.rlike(w, F.lit(KNOWN)) | F.rlike(w, F.lit(f"{CREDENTIAL}[\"']?[:=]+[\"']*[^\"':=]"))

    def spot(i: Column) -> Column:
        """A candidate with its neighbours: what leaves the text's row does not grow with the text."""
        get = lambda k: F.coalesce(F.get("w", i + k), F.lit(""))
        near = F.filter(F.array(get(-2), get(-1), get(1), get(2)), lambda w: F.rlike(w, F.lit("[\\p{L}0-9]")))
        return F.struct(i.alias("position"), get(0).alias("word"), get(-1).alias("last"), F.concat_ws(" ", get(-2), get(-1)).alias("before"), near.alias("near"), F.concat_ws(" ", get(0), get(1), get(2), get(3)).alias("opened"))

    spots = F.filter(F.transform("w", lambda w, i: F.when(wanted(w, i), spot(i))), lambda s: s.isNotNull())
    c = likely.select("id", "path", F.explode(spots).alias("s")).select("id", "path", "s.*")
    key = f"^[\"'({{\\[]*{CREDENTIAL}[\"']?[:=]+[\"']?"
    value = F.regexp_replace(F.regexp_replace("word", key, ""), "^[^A-Za-z0-9+]+|[^A-Za-z0-9=/+]+$", "")
    bare = F.regexp_replace(F.regexp_replace("word", key, ""), "^[\"'(:=]+|[\"'),;]+$", "")
    c = c.withColumn("told", _given(F.col("word"), F.col("last"), F.col("before")) | F.rlike("word", F.lit(key)))
    # a value given to a credential word counts at any length, and one of other signs than the stripped ones stays as it is
    c = c.withColumn("finding", F.when(F.col("word").startswith(PEM), F.col("opened")).when(F.col("told") & (F.length(value) == 0), bare).otherwise(value)).where((F.length("finding") >= 4) | (F.col("told") & (F.length("finding") > 0)))
    n, x = F.length("finding").cast("double"), F.col("finding")
    share = lambda pattern: F.size(F.filter("near", lambda w: F.rlike(w, F.lit(pattern)))) / F.greatest(F.size("near"), F.lit(1))
    c = c.withColumns({
        "length": n, "digits": _count(x, "[0-9]") / n, "uppers": _count(x, "[A-Z]") / n, "lowers": _count(x, "[a-z]") / n,
        "others": _count(x, "[^A-Za-z0-9]") / n, "hex": _count(x, "[0-9a-f]") / n, "distinct": F.size(F.array_distinct(F.split("finding", ""))) / n,
        "letter_digit": _count(x, "[A-Za-z](?=[0-9])") / n, "digit_letter": _count(x, "[0-9](?=[A-Za-z])") / n,
        "lower_upper": _count(x, "[a-z](?=[A-Z])") / n, "upper_lower": _count(x, "[A-Z](?=[a-z])") / n,
        "near_words": share("^[^A-Za-z0-9]*[\\p{L}]{2,}[^A-Za-z0-9]*$"), "near_digits": share("[0-9]"),
        "path_test": F.rlike("path", F.lit(PATH)).cast("double"), "path_depth": F.size(F.split("path", "/")).cast("double"),
        "known": F.rlike("finding", F.lit(f"^(?:{KNOWN})")) | F.col("word").startswith(PEM),
        "placeholder": F.rlike(F.concat_ws(" ", F.concat_ws(" ", "near"), "word"), F.lit(PLACEHOLDER)) | F.rlike("finding", F.lit(FILLED)),
    })
    c = stored(c.select("id", "position", "finding", *[f for f in FEATURES if f != "covered"], *EVIDENCE), "secret-words")
    runs = c.select("finding").distinct().select("finding", F.explode(F.regexp_extract_all(F.lower("finding"), F.lit("\\p{L}{3,}"), F.lit(0))).alias("run"))
    known = runs.join(words.select(F.col("word").alias("run")), "run").groupBy("finding").agg(F.sum(F.length("run")).cast("double").alias("_covered"))
    c = spread_join(c, known, "finding", "left")
    return c.withColumn("covered", F.coalesce(F.col("_covered") / F.col("length"), F.lit(0.0))).select("id", "position", "finding", *FEATURES, *EVIDENCE)


def weak_labels(found: DataFrame) -> DataFrame:
    """label 1.0 for candidates of a well-known key format or given to a credential word, if nothing says placeholder; else 0.0.

    Bare values that are secrets are labelled 0.0 like other bare values; they are few among those, so the forest outvotes the label.
    """
    return found.withColumn("label", F.when((F.col("told") | F.col("known")) & ~F.col("placeholder"), 1.0).otherwise(0.0))


def held_out() -> Column:
    """Whether a finding is not trained on: all its occurrences or none."""
    return F.pmod(F.xxhash64(F.lit("held"), "finding"), F.lit(HELD_OUT)) == 0


def _features(found: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(found)


def trained(labelled: DataFrame, rows: int = TRAIN_ROWS, trees: int = 20, depth: int = 6, seed: int = 3):
    """A forest from labelled findings (FEATURES, label) that are not held out; None if they hold one class only.

    Of more than `rows` labelled findings those below a hash threshold are used, about `rows` of them: no task gathers or sorts them.
    """
    used = labelled.where(~held_out())
    share = min(1.0, rows / max(used.count(), 1))
    if share < 1:
        used = used.where(F.pmod(F.xxhash64("finding", "id", "position"), F.lit(1 << 30)) < int(share * (1 << 30)))
    used = stored(_features(used).select("features", "label"), "secret-train")
    kinds = used.agg(F.min("label").alias("a"), F.max("label").alias("b")).first()
    if kinds["a"] is None or kinds["a"] == kinds["b"]:
        return None
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=5, seed=seed, cacheNodeIds=False).fit(used)


def scored(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """One row a candidate: id, position, finding, FEATURES, EVIDENCE, label (null if not labelled), score. As in scan()."""
    found = stored(candidates(docs, stored(dictionary(docs, text_col), "dictionary"), id_col, text_col, path_col), "secret-candidates")
    if findings is None:
        found = weak_labels(found)
        model = trained(found)
    else:
        known = findings.select(F.col("id").alias("_i"), F.col("position").alias("_p"), "label").where("label IS NOT NULL").dropDuplicates(["_i", "_p"])
        found = stored(found.join(known, F.col("id").eqNullSafe(F.col("_i")) & (F.col("position") == F.col("_p")), "left").drop("_i", "_p"), "secret-labelled")
        model = trained(found.where("label IS NOT NULL"))
    if model is None:
        return found.withColumn("score", F.coalesce("label", F.lit(0.0)))
    return model.transform(_features(found)).withColumn("score", F.get(vector_to_array("probability"), 1)).drop("features", "rawPrediction", "probability", "prediction")


def held_out_report(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Of the labelled findings of scored() that are held out: n, n_secrets, precision and recall of the forest (null over nothing)."""
    hit, true = F.col("score") >= threshold, F.col("label") == 1
    n = lambda c: F.count(F.when(c, 1))
    held = rows.where(held_out() & F.col("label").isNotNull())
    return held.agg(F.count("*").alias("n"), n(true).alias("n_secrets"), (n(hit & true) / F.nullif(n(hit), F.lit(0))).alias("precision"), (n(hit & true) / F.nullif(n(true), F.lit(0))).alias("recall"))


def scan(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", threshold: float = 0.5) -> DataFrame:
    """One row a secret: id_col, position (word of the text, from 0), finding, score.

    `findings` are labelled findings (id, position, label: 1.0 a secret, 0.0 none) of these documents, others are not labelled; without them,
    weak_labels() of all candidates stand in. Without candidates of both classes every candidate labelled a secret stays. Null and empty texts
    hold none, null paths count as empty, null ids stay null, repeated rows give repeated findings, ties of the score none are cut. Extra
    columns are not read. An empty table gives an empty table.
    """
    kept = scored(docs, findings, id_col, text_col, path_col).where(F.col("score") >= threshold)
    return kept.select(F.col("id").alias(id_col), F.col("position").cast("long").alias("position"), "finding", F.round("score", 6).alias("score"))
