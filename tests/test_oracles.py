"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import duckdb
import pytest

from graniteleaf.operators import retrieval
from graniteleaf.plans import oracles, queries

DIR = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations", "events", "nation", "supplier")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET temp_directory = ''")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 8) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(oracles.ORACLE_SQL))
def test_same_rows(spark, con, name):
    df = queries.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    r = con.execute(oracles.ORACLE_SQL[name])
    names = [d[0] for d in r.description]
    want = sorted((tuple(plain(x[names.index(c)]) for c in cols) for x in r.fetchall()), key=repr)
    assert sorted(names) == cols
    assert sorted((tuple(plain(x[c]) for c in cols) for x in df.collect()), key=repr) == want


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_approximate_neighbours_reach_the_recall_on_the_whole_top_k(spark, sf):
    v = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    q, c = v.where("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "embedding"), v.selectExpr("vec_id AS chunk_id", "embedding")
    exact = {(r["query_id"], r["chunk_id"]) for r in retrieval.dense(q, c, 10).collect()}
    found = {(r["query_id"], r["chunk_id"]) for r in retrieval.dense_lsh(q, c, 10).collect()}
    assert len(found) == len(exact) == 10 * q.count()
    assert len(exact & found) >= 0.9 * len(exact)


def test_queries_without_bucket_mates_are_searched_exactly(spark):
    v = spark.createDataFrame([(i, [float(i == j) for j in range(8)]) for i in range(8)], "chunk_id long, embedding array<double>")
    q = v.selectExpr("chunk_id AS query_id", "embedding")
    got = retrieval.dense_lsh(q, v, 5, width=1e-6).collect()
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in retrieval.dense(q, v, 5).collect())
