"""Literal inputs of operators that the driver's tables do not exercise, for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graniteleaf.sources.tables import ship, table

FIXTURES: dict[str, tuple[str, list[tuple]]] = {
    "clean": ("id int, s string", [(1, "10 ^25"), (2, "a\u00a0b"), (3, "‘x’ “y”"), (4, "  two  blanks \t here  "), (5, "line\none"), (6, ""), (7, None)]),
    "supers": ("id int, html string", [(1, '10<span class="oj-super">25</span>'), (2, 'word<span class="oj-super">1</span>'), (3, '7 <span class="oj-super"> 3 </span>x'), (4, '7<span class="oj-super oj-note-tag">3</span>'), (5, '7<span class="oj-super">a</span>')]),
    "blocks": ("doc int, pos int, classes string, text string", [
        (1, 1, "oj-ti-section-1", "CHAPTER I"), (1, 2, "oj-ti-section-2", "General"), (1, 3, "oj-normal", "art one"), (1, 4, "oj-ti-section-1", "Section 1"), (1, 5, "oj-ti-section-2", "Scope"), (1, 6, "oj-normal", "art two"), (1, 7, "oj-note-tag", "note"),
        (1, 8, "oj-ti-section-1", "Chapter II"), (1, 9, "oj-normal", "art three"), (1, 10, "oj-ti-section-2", "Rights"), (1, 11, "oj-ti-section-2", "stray"), (1, 12, "oj-ti-section-1", "TITLE X"), (1, 13, "oj-normal", "art four"), (2, 1, "oj-ti-art", "Article 1"), (2, 2, "oj-normal", "no heading"),
    ]),
    "marked_pages": ("page_id int, html string", [
        (1, '<div class="eli-container"><p class="oj-ti-section-1">CHAPTER I</p><p class="oj-ti-section-2">General &amp; first</p><div class="eli-subdivision" id="art_1"><p class="oj-ti-art">Article 1</p><p class="oj-sti-art">Scope`</p><p class="oj-normal">1. This &lt;rule&gt; holds.</p><p class="oj-note">a note</p><p>2. Also&#8212;here.</p></div>'
            '<div class="eli-subdivision" id="art_2"><p class="oj-ti-art">Article 2</p><p>Only a body.</p></div></div><div class="eli-container" id="anx_I"><p class="oj-doc-ti">ANNEX I</p><p class="oj-doc-ti">Lists</p><p>(a) one</p></div>'),
        (2, '<div id="rct_3" class="eli-subdivision"><p>(3) Whereas x.</p></div>'), (3, "<p>no subdivision</p>"), (4, None),
    ]),
    "kinds": ("id int, classes string, element_id string", [(1, "eli-subdivision", "art_6"), (2, "eli-subdivision", "rct_27"), (3, "eli-container", "anx_III"), (4, "eli-subdivision", "anx_I"), (5, "x eli-subdivision y", "art_99"), (6, "", "art_1")]),
    "units": ("kind string, element_id string, label string, title string, body string, chapter string, chapter_title string, section string, section_title string", [
        ("article", "art_6", "Article 6", "Rules`", "b1", "CHAPTER I", "CHAPTER I - General", "", ""), ("article", "art_7", None, None, "b2", "CHAPTER I", "", "SECTION 1", "SECTION 1 - x"),
        ("recital", "rct_53", None, None, "(53) It is.", "c", "ct", "s", "st"), ("annex", "anx_III", "ANNEX III", "Areas", "b3", "", "", "", ""), ("annex", "anx_IV", None, None, "b4", "", "", "", ""),
    ]),
    "atoms": ("id int, body string", [(1, "1. a\n  b\n(a) c\n(iv) d\nSection A. e\nplain"), (2, "plain only"), (3, ""), (4, "intro\n    (12) x\n1234. no\n(abcd) no")]),
    "sentences": ("id int, body string", [(1, 'See Art. 6 No. 5 rule; But x. (a) y: "Z" end.  Next one.'), (2, "no end"), (3, "")]),
    "crumbs": ("id int, chapter string, section string, citation string, part int, n_parts int", [(1, "Ch", "Sec", "cit", 2, 2), (2, "", "", "cit", 1, 1), (3, "Ch", "", "cit", 1, 1), (4, None, "Sec", "cit", 1, 3)]),
    "answers": ("id int, answer string", [
        (1, "x [Article 99 - Penalties] y [ANNEX III - z] w [Recital (53)]."), (2, "【Article 99 - Penalties】 and 【ANNEX III - x】"), (3, "[Article 6 - X] then [Article 6 - X], but Article 7 is not cited."), (4, "[Article on fines 7]"), (5, "[Article 6; Article 8]"), (6, "none NOT_IN_CORPUS"), (7, ""),
    ]),
    "durations": ("id int, s string", [(1, "205ms"), (2, "7.66s"), (3, "59m2.4s"), (4, "1h2m3s"), (5, ""), (6, "abc"), (7, None), (8, "1.2.3s"), (9, " 2h "), (10, "xms")]),
    "statuses": ("id int, status int, body string", [(1, 200, ""), (2, 429, "slow down"), (3, 429, "limit per day; try again in 59m2.4s"), (4, 429, "TPD reached"), (5, 503, "per day"), (6, 404, "")]),
    "judge_texts": ("id int, s string", [(1, '```json\n{"grade":"correct"}\n```'), (2, 'x [1,{"a":2}] y'), (3, "oops"), (4, '[{"claim_index":0,"supported":true}]'), (5, "{broken} ["), (6, "")]),
    "verdicts": ("id int, s string", [(1, '[{"claim_index":0,"supported":true,"reason":"r"},{"claim_index":1,"supported":false,"reason":"n"}]'), (2, "[]"), (3, "none"), (4, '[{"claim_index":0,"supported":false},{"claim_index":1},{"claim_index":2,"supported":true}]')]),
    "claims": ("id int, claims array<string>", [(1, ["a", "b"]), (2, [str(i) for i in range(25)]), (3, [])]),
    "models": ("model string", [("openai/gpt-oss-20b",), ("llama-3.3-70b",), ("qwen/qwen3.6-27b",), ("Solo",)]),
    "preferences": ("model string, pos int", [("openai/judge-large", 1), ("qwen/judge", 2), ("llama-judge", 3), ("openai/judge-small", 4)]),
    "grades": ("id int, grade string", [(1, "correct"), (2, "partial"), (3, "incorrect"), (4, "great"), (5, None)]),
    "figures": ("id int, p double, d double", [(1, 0.9091, 0.7951), (2, None, None), (3, 1.0, 0.0), (4, 0.33333, 0.12345)]),
    "running": ("setting string, value string", [("mode", "hybrid"), ("k", "8"), ("model", "m1"), ("judge", None)]),
    "measured": ("setting string, value string", [("mode", "hybrid"), ("k", "6"), ("model", None), ("judge", None)]),
    "outlines": ("id int, html string", [(1, "<div><p>Intro</p><table><tr><td>(a)</td><td><p>first</p><table><tr><td>(i)</td><td>deep <b>x</b></td></tr></table></td></tr></table></div>"), (2, "<table><tr><td>1</td><td>2</td><td>3</td></tr></table>"), (3, '<p>a</p><p class="oj-note">n</p>'), (4, None)]),
}


#: Rows of the tables in the fixtures' columns: a table, and one expression a column that Spark and DuckDB read alike. Ids stay clear of the literal ones.
DERIVED: dict[str, tuple[str, tuple[str, ...]]] = {
    "supers": ("documents", ("doc_id + 100", "concat(substr(text, 1, 30), doc_id % 10, CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE '' END, '<span class=\"oj-super', CASE WHEN doc_id % 4 = 0 THEN ' oj-note-tag' ELSE '' END, '\">', doc_id % 100, '</span> of it')")),
    "blocks": ("documents", ("floor(doc_id / 10) + 10", "doc_id % 10", "CASE doc_id % 5 WHEN 0 THEN 'oj-ti-section-1' WHEN 1 THEN 'oj-ti-section-2' WHEN 2 THEN 'oj-note-tag' WHEN 3 THEN 'oj-normal' ELSE 'oj-doc-ti' END", "CASE doc_id % 10 WHEN 0 THEN concat('Chapter ', doc_id) WHEN 5 THEN concat('SECTION ', lang) ELSE substr(text, 1, 20) END")),
    "kinds": ("pages", ("page_id + 100", "CASE page_id % 3 WHEN 0 THEN 'eli-subdivision' WHEN 1 THEN 'x eli-container' ELSE 'other' END", "concat(CASE floor(page_id / 3) % 4 WHEN 0 THEN 'art_' WHEN 1 THEN 'rct_' WHEN 2 THEN 'anx_' ELSE 'fnp_' END, page_id)")),
    "units": ("pages", ("CASE page_id % 3 WHEN 0 THEN 'article' WHEN 1 THEN 'recital' ELSE 'annex' END", "concat(CASE page_id % 3 WHEN 0 THEN 'art_' WHEN 1 THEN 'rct_' ELSE 'anx_' END, page_id)", "CASE WHEN page_id % 2 = 0 THEN concat('Label ', page_id) END", "CASE WHEN page_id % 5 > 0 THEN concat('Title ', page_id, '`') END", "concat('(', page_id, ') ', url)", "concat('CHAPTER ', page_id % 7)", "''", "'s'", "'st'")),
    "crumbs": ("documents", ("doc_id + 100", "CASE WHEN doc_id % 4 > 0 THEN source END", "CASE WHEN doc_id % 3 > 0 THEN lang ELSE '' END", "concat('Document ', doc_id)", "doc_id % 3 + 1", "doc_id % 2 + 2")),
    "answers": ("benchmark", ("item_id + 100", "concat(substr(text, 1, 40), ' [Article ', item_id % 99 + 1, ' - x], see [ANNEX III] or 【Recital (', item_id, ')】 and [Article ', item_id % 99 + 1, '].')")),
    "durations": ("events", ("event_id + 100", "CASE event_id % 5 WHEN 0 THEN concat(event_id % 900, 'ms') WHEN 1 THEN concat(event_id % 60, '.', event_id % 10, 's') WHEN 2 THEN concat(event_id % 60, 'm', event_id % 7, 's') WHEN 3 THEN concat(event_id % 24, 'h', event_id % 60, 'm') ELSE event_type END")),
    "statuses": ("events", ("event_id + 100", "CASE event_type WHEN 'error' THEN 429 WHEN 'view' THEN 200 WHEN 'click' THEN 503 ELSE 404 END", "CASE event_id % 4 WHEN 0 THEN concat('limit per day; try again in ', event_id % 60, 'm', event_id % 9, 's') WHEN 1 THEN 'TPD reached' ELSE props END")),
    "judge_texts": ("conversations", ("conv_id * 100 + turn + 100", "CASE turn % 3 WHEN 0 THEN concat('Grade: {\"grade\":\"', role, '\",\"n\":', turn, '} so') WHEN 1 THEN concat('[', conv_id, ',{\"a\":', turn, '}] x') ELSE role END")),
    "verdicts": ("conversations", ("conv_id * 100 + turn + 100", "concat('[{\"claim_index\":0,\"supported\":', CASE WHEN turn % 2 = 0 THEN 'true' ELSE 'false' END, ',\"reason\":\"', role, '\"},{\"claim_index\":', turn + 1, ',\"supported\":', CASE WHEN conv_id % 3 = 0 THEN 'true' ELSE 'null' END, '}]')")),
    "claims": ("pages", ("page_id + 100", "split(url, '/')")),
    "models": ("nation", ("concat(CASE n_nationkey % 4 WHEN 0 THEN 'openai' WHEN 1 THEN 'llama' WHEN 2 THEN 'qwen' ELSE 'other' END, CASE WHEN n_nationkey % 3 = 0 THEN '-' ELSE '/' END, n_name)",)),
    "grades": ("labels", ("doc_id + 100", "CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'correct' WHEN quality = 0 THEN 'incorrect' END")),
    "figures": ("supplier", ("s_suppkey + 100", "CASE WHEN s_suppkey % 9 > 0 THEN s_nationkey / 25 END", "s_acctbal / 4096")),
    "running": ("nation", ("n_name", "concat('v', n_regionkey)")),
    "measured": ("nation", ("n_name", "CASE WHEN n_nationkey % 5 > 0 THEN concat('v', n_nationkey % 5) END")),
    "outlines": ("pages", ("page_id + 100", "html")),
}


def fixture(spark: SparkSession, name: str, d: str = "") -> DataFrame:
    """The literal rows, and those of the tables under d."""
    ship(spark)
    schema, rows = FIXTURES[name]
    literal = spark.createDataFrame(rows, schema)
    if not d or name not in DERIVED:
        return literal
    source, columns = DERIVED[name]
    kinds = [c.split() for c in schema.split(", ")]
    return literal.unionByName(table(spark, d, source).selectExpr(*[f"CAST({e} AS {k}) AS {c}" for e, (c, k) in zip(columns, kinds, strict=True)]))


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''").replace("\n", "'||chr(10)||'").replace("\t", "'||chr(9)||'") + "'"
    if isinstance(v, list):
        return "[" + ", ".join(map(_literal, v)) + "]::VARCHAR[]"
    return repr(v) + ("::DOUBLE" if isinstance(v, float) else "")


def values(name: str) -> str:
    """The fixture as a relation in SQL, typed."""
    schema, rows = FIXTURES[name]
    cols = [c.split() for c in schema.split(", ")]
    kind = {"int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "array<string>": "VARCHAR[]"}
    body = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    more = ""
    if name in DERIVED:
        source, columns = DERIVED[name]
        more = f" UNION ALL SELECT {', '.join(f'({e})::{kind[t]} AS {c}' for e, (c, t) in zip(columns, cols, strict=True))} FROM {source}"
    return f"(SELECT {', '.join(f'{c}::{kind[t]} AS {c}' for c, t in cols)} FROM (VALUES {body}) AS v({', '.join(c for c, _ in cols)}){more})"
