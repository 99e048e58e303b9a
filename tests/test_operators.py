"""Literal cases of the retrieval and evaluation operators, and models in plain Python."""

import math
import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graniteleaf.config import DEFAULT
from graniteleaf.functions import text as T
from graniteleaf.operators import chunking, evaluation, judging, metrics, parsing, ratelimit, retrieval
from graniteleaf.plans import queries
from graniteleaf.plans.fixtures import fixture
from graniteleaf.sources import tables


def rows(df):
    return [tuple(r) for r in df.collect()]


def scores(spark, hits, gold, k):
    h = spark.createDataFrame([(1, u, i) for i, u in enumerate(hits, 1)], "query_id int, unit_id string, rank int")
    g = spark.createDataFrame([(1, gold)], "query_id int, gold_units array<string>")
    return metrics.metrics_at(h, g, [k]).first().asDict()


def test_metrics(spark):
    three = scores(spark, ["art_1", "art_6", "art_99"], ["art_6", "art_99"], 3)
    assert (three["hit_rate"], three["recall"], three["full_recall"], three["mrr"]) == (1, 1, 1, 0.5)
    two = scores(spark, ["art_1", "art_6", "art_99"], ["art_6", "art_99"], 2)
    assert (two["recall"], two["full_recall"]) == (0.5, 0)
    assert scores(spark, ["art_2"], ["art_6", "art_99"], 1)["hit_rate"] == 0
    same = scores(spark, ["art_6", "art_6"], ["art_6", "art_99"], 2)
    assert (same["precision"], same["recall"]) == (1, 0.5)
    assert scores(spark, ["art_99"], ["art_99"], 3)["ndcg"] == 1
    assert math.isclose(scores(spark, ["a", "b", "art_99"], ["art_99"], 3)["ndcg"], 0.5)


def test_queries_without_hits_are_misses(spark):
    h = spark.createDataFrame([(1, "a", 1)], "query_id int, unit_id string, rank int")
    g = spark.createDataFrame([(1, ["a"]), (2, ["b"]), (3, [])], "query_id int, gold_units array<string>")
    got = {r["query_id"]: r["hit_rate"] for r in metrics.metrics_at(h, g, [3]).collect()}
    assert got == {1: 1.0, 2: 0.0}


def test_fixtures(spark):
    q = {n: dict(rows(queries.QUERIES[n](spark, ""))) for n in ("superscript_repair", "parse_citations", "parse_duration", "extract_json", "faithfulness", "model_family")}
    assert dict(rows(fixture(spark, "clean").select("id", T.clean_text(F.col("s"))))) == {1: "10^25", 2: "a b", 3: "'x' \"y\"", 4: "two blanks here", 5: "line\none", 6: "", 7: None}
    assert q["superscript_repair"][1] == "10^25" and "oj-super" in q["superscript_repair"][2] and "oj-note-tag" in q["superscript_repair"][4]
    assert q["parse_citations"] == {1: "art_99,anx_III,rct_53", 2: "art_99,anx_III", 3: "art_6", 4: "art_i", 5: "art_6", 6: "", 7: ""}
    assert [q["parse_duration"][i] for i in range(1, 7)] == [0.205, 7.66, 3542.4, 3723, 0, 0]
    assert q["extract_json"] == {1: '{"grade":"correct"}', 2: '[1,{"a":2}]', 3: None, 4: '[{"claim_index":0,"supported":true}]', 5: None, 6: None}
    assert q["faithfulness"][1] == 0.5 and q["faithfulness"][2] is None and q["faithfulness"][3] is None
    assert q["model_family"]["openai/gpt-oss-20b"] == "openai" and q["model_family"]["llama-3.3-70b"] == "llama"
    assert all(judge.split("/")[0].split("-")[0] != model.split("/")[0].split("-")[0] for model, judge in rows(queries.pick_judge(spark, "")))


def test_outline(spark):
    got = dict(rows(queries.render_outline(spark, "")))
    assert got[1] == "Intro\n(a) first\n        (i) deep\n            x" and got[2] == "1 2 3" and got[3] == "a" and got[4] is None


def test_outline_of_odd_markup(spark):
    cases = [
        "<p>one<p>two<p>three", "<div>" * 2000 + "deep", "<table>" + "<tr><td>a<td><table>" * 300 + "<tr><td>x<td>y", "<table><tr><td></td><td><p>only</p><p>body</p></td></tr></table>",
        "<table><tr><td>a</td><td>b</td></tr><tr><td>c<td>d</table>after", "<p>5 &amp; 6<br>7</p>", '<div class="oj-note">x<div>y</div></div>z', '<table><tr><td><span class="oj-note-tag">n</td><td>m</td></tr></table>', "", "<script>var a = '<p>';</script>t",
    ]
    got = [r[0] for r in spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "id int, html string").orderBy("id").select(parsing.render_outline("html")).collect()]
    assert got[0] == "one\ntwo\nthree" and got[1] == "deep" and got[3] == "only\n    body" and got[4] == "a b\nc d\nafter"
    assert got[2].startswith("a ") and got[2].rstrip().endswith("x y") and got[5] == "5 & 6 7" and got[6] == "z" and got[7] == "m" and got[8] == "" and got[9] == "t"


def test_fixed_digits_as_printf(spark):
    rng = __import__("random").Random(3)
    values = [0.4295, 0.0005, 0.0015, 0.1235, 1.0, 0.0, -0.25, 12.3456, 0.9995, *[round(rng.random(), 4) for _ in range(400)]]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for d in (1, 3):
        assert [r[0] for r in df.select(T.fixed(F.col("x"), d)).collect()] == [f"{v:.{d}f}" for v in values]


def test_character_references(spark):
    cases = {"a &amp;lt; b": "a &lt; b", "&lt;p&gt;": "<p>", "&#233;&#xE9;&#x1F600;": "éé😀", "&#38;amp; &amp": "&amp; &", "&#0;&#xD800;": "\ufffd\ufffd", "&bogus; &am": "&bogus; &am", "&#12 x": "&#12 x", "": "", "&#": "&#", "&nbsp;&hellip;": "\u00a0…", "&#038;": "&"}
    got = spark.createDataFrame([(k,) for k in cases], "s string").select("s", T.decode_references(F.col("s")))
    assert dict(rows(got)) == cases


def test_padding_stands_before_negative_scores(spark):
    """700 chunks with the term, whose weight is negative, before 20 empty ones: the first in the ranking are the empty ones."""
    c = spark.createDataFrame([(i, "article", "word" if i < 700 else "") for i in range(720)], "chunk_id int, kind string, text string")
    q = spark.createDataFrame([(1, "word"), (2, "none"), (3, None)], "query_id int, question string")
    odd = DEFAULT.__class__(bm25_floor=-1.0)
    scored = retrieval.bm25_scores(q, c).withColumn("score", -F.abs("score") - 0.1)
    pad = retrieval.padding(q, scored, c, 5)
    assert sorted(rows(pad.select("query_id", "chunk_id"))) == [(1, i) for i in range(700, 705)] + [(2, i) for i in range(5)] + [(3, i) for i in range(5)]
    ranked = retrieval.bm25(q, c, 25, odd, padded=True).where("query_id = 1").orderBy("rank").collect()
    assert len(ranked) == 25
    best = retrieval.top_k(scored.unionByName(pad), 5, 6).where("query_id = 1").orderBy("rank").collect()
    assert [r["chunk_id"] for r in best] == list(range(700, 705)) and all(r["score"] == 0 for r in best)


def test_dense_without_nulls_and_in_tiles(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)] + [(99, None)], "chunk_id long, embedding array<double>")
    q = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(7)] + [(9, None)], "query_id long, embedding array<double>")
    want = sorted(rows(retrieval.dense(q, v, 3)))
    monkeypatch.setattr(retrieval, "TILE", 16)
    assert sorted(rows(retrieval.dense(q, v, 3))) == want and len(want) == 21 and {r[1] for r in want if r[0] == 0} == {39, 38, 37}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_neighbours_among_many_equal_vectors(spark, monkeypatch, kind):
    """A third of all vectors are one; ties go to the least ids, in tiles of any size, and no more than k a query leave a task."""
    name = (lambda i: i) if kind == "long" else (lambda i: f"v{i:03}")
    flat = [(name(i), [1.0, 0.0] if i % 3 == 0 else [math.cos(i), math.sin(i)]) for i in range(120)]
    v = spark.createDataFrame(flat[::-1], f"chunk_id {kind}, embedding array<double>").coalesce(1)
    q = spark.createDataFrame([(i, [math.cos(i / 9), math.sin(i / 9)]) for i in range(5)], "query_id long, embedding array<double>")
    score = lambda a, b: round(a[0] * b[0] + a[1] * b[1], 5)
    want = []
    for i in range(5):
        own = [math.cos(i / 9), math.sin(i / 9)]
        want += [(i, n) for _, n in sorted((-score(own, e), n) for n, e in flat)[:4]]
    monkeypatch.setattr(retrieval, "TILE", 70)
    for found in (retrieval.dense(q, v, 4), retrieval.dense_lsh(q, v, 4, width=100.0)):
        assert sorted((r["query_id"], r["chunk_id"]) for r in found.collect()) == sorted(want)


def test_service_side(spark, tmp_path):
    from graniteleaf.operators import grounding, report

    assert ratelimit.available("groq", {}) is False and ratelimit.available("ollama", {}) and ratelimit.available("x", {}) is False
    models = spark.createDataFrame([("groq", "b"), ("groq", "a")], "provider string, model string")
    assert ratelimit.listed_models(models, "groq") == ["a", "b"] and ratelimit.listed_models(spark.range(1), "groq") == []
    assert issubclass(ratelimit.DailyQuotaExhausted, ratelimit.Unavailable)
    told = grounding.asked_service(spark.createDataFrame([(1, "p")], "query_id long, prompt string"), lambda p: p.upper())
    assert rows(told) == [(1, "P")]
    row = spark.createDataFrame([("q", "a", "[]", 1)], "question string, answer string, context string, place int")
    for f in (judging.claims_prompt(F.col("question"), F.col("answer")), judging.verify_prompt(F.col("context"), F.lit("0. c")), judging.grade_prompt(F.col("question"), F.lit("r"), F.col("answer"))):
        assert "a" in row.select(f).first()[0]
    assert evaluation.to_save(row.withColumn("contexts", F.array(F.lit("c")))).columns == row.columns
    built = []
    ensure = lambda: tables.ensure_index(spark, str(tmp_path / "i"), lambda: built.append(1) or spark.range(3))
    assert ensure().count() == 3 and ensure().count() == 3 and built == [1]
    lines = report.markdown([("T", row, ["question", "answer"], "place")])
    assert [r["line"] for r in lines.orderBy("ord").collect()] == ["", "## T", "", "| question | answer |", "|---|---|", "| q | a |"]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.html").write_text('<div class="eli-subdivision">é</div>')
    assert "é" in tables.read_pages(spark, str(tmp_path / "p")).first()["html"]
    (tmp_path / "p" / "b.html").write_text("error")
    with pytest.raises(Exception, match="no subdivision"):
        tables.read_pages(spark, str(tmp_path / "p")).collect()


def test_headings_and_atoms(spark):
    got = {(r["doc"], r["pos"]): (r["chapter"], r["section"]) for r in parsing.forward_fill_headings(fixture(spark, "blocks")).collect()}
    assert got[1, 3] == ("CHAPTER I", "") and got[1, 6] == ("CHAPTER I", "Section 1") and got[1, 9] == ("Chapter II", "")
    atoms = fixture(spark, "atoms").where("id = 1").select(chunking.atoms(F.col("body"))).first()[0]
    assert atoms == ["1. a\n  b", "(a) c", "(iv) d", "Section A. e\nplain"]


def test_token_estimate_is_binary(spark):
    df = spark.createDataFrame([(n, " ".join(["w"] * n)) for n in (0, 1, 5, 45, 85)], "n int, s string")
    assert dict(rows(df.select("n", T.approx_tokens(F.col("s"))))) == {0: 1, 1: 2, 5: 8, 45: 63, 85: 119}


def test_packing(spark):
    sizes = [100, 200, 150, 300, 10, 50]
    pieces = [" ".join(["w"] * int((n - 1) / 1.4 + 0.999)) for n in sizes]
    df = spark.createDataFrame([(pieces,)], "p array<string>")
    got = df.select(chunking.pack(F.col("p"), 420, "|")).first()[0]
    assert [len(x.split("|")) for x in got] == [2, 1, 3]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab .;N\n(", max_size=60), min_size=1, max_size=20), st.integers(3, 30))
def test_packing_matches_a_plain_loop(spark, texts, budget):
    def plain(pieces):
        out, cur, tok = [], [], 0
        for p in pieces:
            t = int(len(p.split()) * 1.4) + 1
            if cur and tok + t > budget:
                out.append("\n".join(cur))
                cur, tok = [], 0
            cur.append(p)
            tok += t
        return out + ["\n".join(cur)] if cur else out

    df = spark.createDataFrame([(texts,)], "p array<string>")
    assert df.select(chunking.pack(F.col("p"), budget, "\n")).first()[0] == plain(texts)


def test_fusion_order_and_ties(spark):
    run = lambda ids: spark.createDataFrame([(1, c, 0.0, i) for i, c in enumerate(ids, 1)], "query_id int, chunk_id string, score double, rank int")
    kinds = spark.createDataFrame([(c, "recital" if c == "d" else "article") for c in "abcd"], "chunk_id string, kind string")
    out = retrieval.fused({"dense": run("abc"), "bm25": run("bda")}, kinds, 10, [1.0, 0.5, 0.0])
    order = {w: [r["chunk_id"] for r in out.where(F.col("weight") == w).orderBy("rank").collect()] for w in (1.0, 0.5, 0.0)}
    assert order == {1.0: ["b", "a", "d", "c"], 0.5: ["b", "a", "c", "d"], 0.0: ["b", "a", "c"]}


def test_search_arguments(spark):
    q, c = spark.createDataFrame([], "query_id int, question string"), spark.createDataFrame([], "chunk_id int, kind string, text string")
    with pytest.raises(KeyError):
        retrieval.search(q, c, 3, "other")
    with pytest.raises(ValueError):
        retrieval.search(q, c, 0, "bm25")
    assert retrieval.search(q, c, 3, "hybrid").count() == 0
    assert (DEFAULT.top_k, DEFAULT.rrf_k, DEFAULT.pool, DEFAULT.kind_weight) == (6, 60, 30, 0.5)


def test_failure_taxonomy(spark):
    cases = [
        ("unanswerable", True, None, None, "correct", "ok"), ("unanswerable", False, None, None, "incorrect", "hallucination_no_abstain"), ("single_hop", False, 0.0, 0.0, "correct", "retrieval_miss"), ("single_hop", True, 1.0, 1.0, "incorrect", "false_abstention"),
        ("multi_hop", False, 1.0, 0.0, "correct", "partial_retrieval"), ("single_hop", False, 1.0, 1.0, "incorrect", "generation_error"), ("single_hop", False, 1.0, 1.0, "partial", "incomplete_answer"), ("single_hop", False, 1.0, 1.0, "unscored", "ok"),
    ]
    df = spark.createDataFrame(cases, "t string, a boolean, h double, f double, g string, want string")
    args = [F.col(c) for c in "tahfg"]
    assert all(r[0] == r[1] for r in df.select(evaluation.failure(*args), "want").collect())
    assert df.select(evaluation.failure(*args, strict=True)).collect()[-1][0] == "unscored"


def test_rolling_minute(spark):
    df = spark.createDataFrame([("m", 0, 1), ("m", 50, 2), ("m", 61, 4)], "model string, s int, tokens int").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["s"]: (r["spent"] + r["tokens"], r["would_block"]) for r in ratelimit.rolling_budget(df, 60, 10, fraction=0.5).collect()}
    assert got == {0: (1, False), 50: (3, False), 61: (6, True)}


def test_models_and_means(spark):
    df = spark.createDataFrame([("b", ""), ("a", None), (None, "x"), ("a", "x")], "gen_model string, judge_model string")
    assert tuple(evaluation.models_from(df).first()) == ("a + b + unknown", "unknown + x")
    assert spark.createDataFrame([(1.0,), (None,), (0.0,)], "x double").agg(metrics.mean("x")).first()[0] == 0.5
    assert spark.createDataFrame([(None,)], "x double").agg(metrics.mean("x")).first()[0] is None


def test_judge_default_when_all_are_of_the_family(spark):
    g, p = spark.createDataFrame([("a/x",)], "model string"), spark.createDataFrame([("a/y", 1)], "model string, pos int")
    assert judging.pick_judge(g, p, "z/z").first()["judge"] == "z/z"


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("q1", "single_hop", "frage ü", ["a"], None, "p")], "id string, type string, question string, gold_units array<string>, reference string, probe string")
    path = str(tmp_path / "q")
    tables.write_jsonl(df, path)
    with open(next(tmp_path.glob("q/*.json")), "a", encoding="utf-8") as f:
        f.write("\n\n")
    for crc in tmp_path.glob("q/.*.crc"):
        os.remove(crc)
    assert rows(tables.read_questions(spark, path).where("id is not null")) == rows(df)
    out = str(tmp_path / "done")
    for i in ("x", "y"):
        tables.append_checkpoint(spark.createDataFrame([(i,)], "id string"), out)
    done = tables.read_checkpoint(spark, out)
    assert sorted(r["id"] for r in done.collect()) == ["x", "y"]
    assert [r["id"] for r in evaluation.pending(spark.createDataFrame([("x",), ("z",)], "id string"), done, "id").collect()] == ["z"]
    tables.write_document(spark, {"a": spark.range(2), "b": spark.range(1)}, str(tmp_path / "doc"))
    assert len(tables.read_document(spark, str(tmp_path / "doc")).first()["a"]) == 2


def test_streaming_ledger(spark, tmp_path):
    from graniteleaf.streaming.ledger import sliding_spend

    calls = spark.createDataFrame([("m", 0, 5), ("m", 30, 7)], "model string, s int, tokens int").select("model", F.timestamp_seconds("s").alias("ts"), "tokens")
    calls.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(calls.schema).parquet(str(tmp_path / "in"))
    q = sliding_spend(stream, 60, 30, limit=10).writeStream.outputMode("complete").format("memory").queryName("spend").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("spend").orderBy("start").collect()
    assert [(r["spent"], r["over"]) for r in got] == [(5, False), (12, True), (7, False)]


def test_indexed_bm25_is_the_same(spark, tmp_path):
    from graniteleaf.operators import indexing
    from graniteleaf.plans import base

    d = "/root/testdata/sf0.001"
    indexing.write_lexical_index(indexing.lexical_index(base.corpus(spark, d)), str(tmp_path / "i"))
    got = retrieval.bm25_indexed(base.asked(spark, d), spark.read.parquet(str(tmp_path / "i")), 10)
    assert sorted(rows(got)) == sorted(rows(queries.bm25_topk(spark, d)))


def test_command_line(spark, capsys):
    from graniteleaf.__main__ import main

    main(["/root/testdata/sf0.001", "--query", "provider_lookup"])
    assert "groq" in capsys.readouterr().out
    main(["/root/testdata/sf0.001", "--modes", "bm25", "--ks", "3", "--limit", "40"])
    out = capsys.readouterr().out
    assert "bm25" in out and "dense" not in out


# the element tree


def _tree_cases() -> list[str]:
    return [
        "<p>one<p>two<p>three", "<div>" * 50 + "deep", "<table>" + "<tr><td>a<td><table>" * 30 + "<tr><td>x<td>y", "<table><tr><td></td><td><p>only</p><p>body</p></td></tr></table>",
        "<table><tr><td>a</td><td>b</td></tr><tr><td>c<td>d</table>after", "<p>5 &amp; 6<br>7</p>", '<div class="oj-note">x<div>y</div></div>z', "", "<script>var a = '<p>';</script>t", "<!-- <p>no</p> --><p>a</p><style>p</style>",
        "<div><p>Intro</p><table><tr><td>(a)</td><td><p>first</p><table><tr><td>(i)</td><td>deep <b>x</b></td></tr></table></td></tr></table></div>", "<table><tr><td>1</td><td>2</td><td>3</td></tr></table>", '<p>a</p><p class="oj-note">n</p>',
        "Intro:<table><tr><td><p>(a)</p></td><td><p>first point</p></td></tr><tr><td>(b)</td><td>second point</td></tr></table>tail<div>x</div>more", "<table><tr><td></td><td><table><tr><td>k</td><td>v</td></tr><tr><td>k2</td><td>v2</td></tr></table></td></tr></table>",
        "<table><tr><td>m</td><td><table><tr><td>1</td><td>2</td><td>3</td></tr></table>end</td></tr></table>", "<table><tr><td><table><tr><td>i</td><td>j</td></tr></table></td><td>B</td><td>C</td></tr></table>", "a\n\nb<p>c\n\n d</p><table><tr><td>m</td><td>x\n\ny<p>z\nw</p></td></tr></table>",
    ]


def test_outlines_of_the_tree_are_those_of_the_pages(spark):
    cases = _tree_cases()
    df = spark.createDataFrame([(i, f"<body>{c}") for i, c in enumerate(cases)], "page_id int, html string")
    want = [r[0] for r in spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "id int, html string").orderBy("id").select(parsing.render_outline("html")).collect()]
    got = dict(rows(parsing.page_outline(df)))
    assert [got.get(i, "") for i in range(len(cases))] == want


def test_tree_intervals_and_holders(spark):
    html = "<div><p>a<b>c</b>d<p>e</div><div>f<div>g<div></div></div></div>tail"
    nodes = parsing.page_nodes(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id int, html string"))
    n = {r["pre"]: r for r in nodes.collect()}
    assert {r["page_id"] for r in n.values()} == {1} and sorted(n) == list(range(len(n)))
    for a in n.values():
        assert a["pre"] <= a["last"] and (a["parent"] == -1 or n[a["parent"]]["pre"] < a["pre"] <= a["last"] <= n[a["parent"]]["last"])
    inside = {(r["pre"], r["level"], r["holder"]) for r in parsing.holders(nodes, F.col("tag") == "div", F.lit(True)).collect()}
    want = set()
    for a in n.values():
        over = sorted(b["pre"] for b in n.values() if b["tag"] == "div" and b["pre"] < a["pre"] <= b["last"])
        want |= {(a["pre"], i + 1, h) for i, h in enumerate(over)}
    assert inside == want


def test_units_keep_all_their_text(spark):
    html = """<div class="eli-subdivision" id="art_51"><p class="oj-ti-art">Article 51</p><div><p class="oj-sti-art">Models`</p></div>Intro:<table><tr><td><p>(a)</p></td><td><p>first <b>point</b> here</p></td></tr>
    <tr><td>(b)</td><td>second point</td></tr></table><p>greater than 10<span class="oj-super">25</span> flops<span class="oj-super oj-note-tag">7</span>, word<span class="oj-super">1</span></p><div><p>in</p>after child</div>
    <div class="eli-subdivision" id="rct_9"><p>(9) Inner unit.</p></div></div>"""
    got = {r["unit_id"]: r for r in parsing.page_units(spark.createDataFrame([(1, html), (2, "<p>none</p>")], "page_id int, html string"), "u").collect()}
    assert set(got) == {"art_51", "rct_9"} and got["art_51"]["citation"] == "Article 51 - Models"
    assert got["art_51"]["body"] == "Intro:\n(a) first point here\n(b) second point\ngreater than 10^25 flops 7 , word 1\nin\nafter child\n(9) Inner unit."
    assert got["rct_9"]["body"] == "Inner unit." and got["rct_9"]["chapter"] == "Recitals"


def test_asked_service_leaves_null_prompts_alone(spark):
    from graniteleaf.operators import grounding

    got = grounding.asked_service(spark.createDataFrame([(1, "a"), (2, None)], "query_id long, prompt string"), str.upper)
    assert sorted(rows(got)) == [(1, "A"), (2, None)]
