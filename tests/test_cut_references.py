"""Pages whose titles are cut within a character reference give the rows of the SQL: without its semicolon only &amp is one."""

import duckdb
import pytest
from pyspark.sql import functions as F

from graniteleaf.functions import text as T
from graniteleaf.operators import parsing
from graniteleaf.plans import oracles, queries

ENDS = ["&", "&a", "&am", "&amp", "&amp;", "&q", "&quo", "&quot", "&quot;", "&l", "&lt", "&lt;", "&gt", "&gt;", "&copy", "&copy;", "&middot", "&quot x", "&ampquot;", "&amp;quot", "&copyx;"]
PAGE = '<!DOCTYPE html><html lang="en"><head><title>{0}</title></head><body><nav><ul><li><a href="/a">a</a></li><li><a href="/b">b</a></li></ul></nav><article><h1>{0}</h1><p>{0} &amp; more.</p></article><footer>&copy; 1 &middot; x</footer></body></html>'


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("cut")
    spark.createDataFrame([(i, PAGE.format(f"Token = {e}")) for i, e in enumerate(ENDS)], "page_id long, html string").coalesce(1).write.parquet(f"{d}/pages.parquet")
    return str(d)


def same_rows(spark, pages, name):
    con = duckdb.connect()
    con.execute("SET temp_directory = ''")
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{pages}/pages.parquet/*.parquet')")
    r = con.execute(oracles.ORACLE_SQL[name])
    names = [d[0] for d in r.description]
    want = sorted(r.fetchall(), key=repr)
    assert want and sorted(map(tuple, queries.QUERIES[name](spark, pages).select(*names).collect()), key=repr) == want


def test_references_without_a_semicolon_stay_as_text(spark):
    cases = {"&quot": "&quot", "a &lt b": "a &lt b", "&gt": "&gt", "&quot;&lt;&gt;": '"<>', "&amp": "&", "&copy": "&copy"}
    got = spark.createDataFrame([(k,) for k in cases], "s string").select("s", T.decode_references(F.col("s")))
    assert dict(map(tuple, got.collect())) == cases


def test_page_blocks(spark, pages):
    same_rows(spark, pages, "page_blocks")


def test_page_text(spark, pages):
    same_rows(spark, pages, "page_text")


def test_outlines_agree(spark, pages):
    """The outline of a page by the one function and by the tree."""
    p = spark.read.parquet(f"{pages}/pages.parquet")
    body = p.select("page_id", F.regexp_replace("html", "(?s)^.*<body>", "").alias("html"))
    assert dict(map(tuple, body.select("page_id", parsing.render_outline("html")).collect())) == dict(map(tuple, parsing.page_outline(p).collect()))


def test_page_chunks(spark, pages):
    same_rows(spark, pages, "page_chunks")


def test_page_units(spark, pages):
    same_rows(spark, pages, "page_units")
