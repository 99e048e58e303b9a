"""The registered queries: SQL where there is some, and the pipeline against brute force."""

import re

import duckdb
import pytest

import corpus_pipeline
from graniteleaf.llm import queries
from graniteleaf.llm.common import stored, table

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    r = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in r.description]
    df = queries.QUERIES[name](spark, DIR)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    want = sorted((tuple(plain(x[names.index(c)]) for c in df.columns) for x in r.fetchall()), key=repr)
    assert sorted((tuple(map(plain, x)) for x in df.collect()), key=repr) == want


def test_one_query_an_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_pipeline_stage_by_stage(spark):
    first = docs = table(spark, DIR, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, DIR), name)
        seen[name] = docs.collect()
        if name != "sharded":
            assert docs.columns == first.columns
    texts = {r["doc_id"]: r["text"] for r in first.collect()}
    # rejected: only what looks like junk (signs in every word, one word over and over, capitals, tables)
    gone = set(texts) - {r["doc_id"] for r in seen["quality"]}
    assert gone and all(re.search(r"[#*$%&]{3}|!!|\|", texts[i]) or len(set(words(texts[i]))) < 0.3 * len(words(texts[i])) or len(words(texts[i])) < 25 for i in gone)
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in (words(r["text"]) for r in seen["near_duplicates"])]
    assert not any(len(a & b) >= 0.8 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    items = [re.sub(r"\s+", " ", r["text"]).strip() for r in table(spark, DIR, "benchmark").collect()]
    assert not any(i in re.sub(r"\s+", " ", r["text"]) for r in seen["decontaminated"] for i in items)
    assert len(seen["near_duplicates"]) - len(seen["decontaminated"]) <= 40
    assert {r["doc_id"] for r in seen["mixed"]} <= {r["doc_id"] for r in seen["decontaminated"]}
    assert len(seen["sharded"]) == len(seen["mixed"])
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, DIR).collect()) == sorted(r["doc_id"] for r in seen["sharded"])


@pytest.mark.parametrize("some", [True, False])
def test_pipeline_on_odd_tables(spark, tmp_path, some):
    """Nulls in every column, blank and repeated rows, no labels, an empty benchmark, empty tables."""
    long = "word " * 3 + " ".join(f"w{i}" for i in range(60_000))
    rows = [(None, None, None, None, None), (1, None, "en", None, 3), (2, "", None, "s", None), (3, " \n", "en", "s", 2), (4, long, "en", "s", 1), (4, long, "en", "s", 1), (None, long, "en", "t", 1), (5, "a short text of eight words or so", "en", "t", 1)]
    docs = spark.createDataFrame(rows if some else [], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, None, None), (None, 1, 0)] if some else [], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None), (None, "")] if some else [], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = [r["text"] for r in out.collect()]
    assert set(got) <= {r[1] for r in rows} and (bool(got) == some)
    assert got.count(long) >= (1 if some else 0)
