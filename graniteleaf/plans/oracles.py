"""DuckDB SQL of the queries, written apart from the Spark code over the same tables and fixtures."""

from __future__ import annotations

from graniteleaf.config import DEFAULT
from graniteleaf.functions.text import CITATION
from graniteleaf.operators import ratelimit, report
from graniteleaf.plans.base import BASE_URL, K, POOL, WEIGHTED_SOURCES
from graniteleaf.plans.fixtures import _literal, values
from graniteleaf.plans.queries import KS, WEIGHTS

TOKENS = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
_KIND = f"CASE WHEN source IN ({', '.join(repr(x) for x in WEIGHTED_SOURCES)}) THEN 'recital' ELSE 'article' END"
CORPUS = f"corpus AS (SELECT doc_id AS chunk_id, {_KIND} AS kind, text FROM documents)"
QUESTIONS = """gold AS (SELECT item_id AS query_id, list(doc_id ORDER BY doc_id) AS g FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1),
questions AS (SELECT item_id AS query_id, item_id AS ord, text AS question, coalesce(g, []::BIGINT[]) AS gold_units, 'ref ' || item_id AS reference,
  CASE len(coalesce(g, [])) WHEN 0 THEN 'unanswerable' WHEN 1 THEN 'single_hop' ELSE 'multi_hop' END AS type FROM benchmark LEFT JOIN gold ON query_id = item_id)"""
TERMS = f"""tok AS (SELECT chunk_id, unnest({TOKENS.format("text")}) AS term FROM corpus),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT chunk_id, len({TOKENS.format("text")}) AS dl FROM corpus), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), w0 AS (SELECT term, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS w FROM df, st),
idf AS (SELECT term, df, CASE WHEN w < 0 THEN 0.25::DOUBLE * (SELECT avg(w) FROM w0) ELSE w END AS idf FROM w0)"""


def bm25(asked: str) -> str:
    return f"""qt AS (SELECT query_id, unnest({TOKENS.format("question")}) AS term FROM {asked}),
bs AS (SELECT query_id, chunk_id, round(sum(idf * (tf * 2.5::DOUBLE) / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
  FROM qt JOIN tf USING (term) JOIN idf USING (term) JOIN dl USING (chunk_id), st GROUP BY ALL),
br AS (SELECT query_id, chunk_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id))::INTEGER AS rank FROM bs)"""


ASKED = "asked AS (SELECT item_id AS query_id, text AS question FROM benchmark)"
LEX = f"{CORPUS}, {ASKED}, {TERMS}, {bm25('asked')}"
_BUCKET = "('0x' || substr(md5(term), 1, 4))::BIGINT % 64"
DENSE = f"""dc AS (SELECT chunk_id, {_BUCKET} AS b, sum(tf)::DOUBLE AS c FROM tf GROUP BY ALL), dn AS (SELECT chunk_id, sqrt(sum(c * c)) AS m FROM dc GROUP BY 1),
qd AS (SELECT query_id, unnest({TOKENS.format("('" + DEFAULT.query_prefix + "' || question)")}) AS term FROM asked), qc AS (SELECT query_id, {_BUCKET} AS b, count(*)::DOUBLE AS c FROM qd GROUP BY ALL), qn AS (SELECT query_id, sqrt(sum(c * c)) AS m FROM qc GROUP BY 1),
ds AS (SELECT qc.query_id, dc.chunk_id, round(sum((dc.c / dn.m) * (qc.c / qn.m)), 9) AS score FROM qc JOIN dc USING (b) JOIN dn USING (chunk_id) JOIN qn USING (query_id) GROUP BY ALL),
dr AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ds)"""


def fused(weights: list[float]) -> str:
    each = ", ".join(f"({w}::DOUBLE)" for w in weights)
    return f"""legs AS (SELECT query_id, chunk_id, min(d) AS d, min(b) AS b FROM (SELECT query_id, chunk_id, rank AS d, NULL AS b FROM dr WHERE rank <= {POOL} UNION ALL SELECT query_id, chunk_id, NULL, rank FROM br WHERE rank <= {POOL}) GROUP BY ALL),
fs AS (SELECT weight, query_id, chunk_id, d, b, round((CASE WHEN kind = 'recital' THEN weight ELSE 1.0::DOUBLE END) * (coalesce(1.0::DOUBLE / (60 + d), 0) + coalesce(1.0::DOUBLE / (60 + b), 0)), 9) AS score
  FROM legs JOIN corpus USING (chunk_id), (VALUES {each}) AS v(weight) WHERE NOT (weight = 0 AND kind = 'recital')),
fr AS (SELECT weight, query_id, chunk_id, score, (row_number() OVER (PARTITION BY weight, query_id ORDER BY score DESC, coalesce(d, 1000000 + b)))::INTEGER AS rank FROM fs)"""


def scores(hits: str, ks: list[int], by: str = "") -> str:
    """sc: the six metrics of hits(by, query_id, unit_id, rank) against questions."""
    b = f"{by}, " if by else ""
    grid = f"(SELECT DISTINCT {by} FROM {hits}) AS groups, " if by else ""
    return f"""ks AS (SELECT unnest({sorted(set(ks))})::INTEGER AS k),
fu AS (SELECT {b}k, query_id, unit_id, min(rank) AS f FROM {hits}, ks WHERE rank <= k GROUP BY ALL),
ur AS (SELECT *, row_number() OVER (PARTITION BY {b}k, query_id ORDER BY f) AS r FROM fu),
gr AS (SELECT {b}k, query_id, gold_units FROM {grid}ks, questions WHERE len(gold_units) > 0),
hi AS (SELECT {", ".join("gr." + x for x in ([by] if by else []) + ["k", "query_id", "gold_units"])}, r, unit_id IS NOT NULL AS got, list_contains(gold_units, unit_id) AS hit FROM gr LEFT JOIN ur USING ({b}k, query_id)),
sc AS (SELECT {b}k, query_id, (count(*) FILTER (WHERE hit) > 0)::INTEGER::DOUBLE AS hit_rate, count(*) FILTER (WHERE hit) / len(gold_units)::DOUBLE AS recall,
  (count(*) FILTER (WHERE hit) = len(gold_units))::INTEGER::DOUBLE AS full_recall, coalesce(count(*) FILTER (WHERE hit) / nullif(count(*) FILTER (WHERE got), 0)::DOUBLE, 0) AS precision,
  coalesce(1.0::DOUBLE / min(r) FILTER (WHERE hit), 0) AS mrr, coalesce(sum(1.0::DOUBLE / log2(r + 1)) FILTER (WHERE hit), 0) / (SELECT sum(1.0::DOUBLE / log2(i + 1)) FROM range(1, least(len(gold_units), k) + 1) AS x(i)) AS ndcg
  FROM hi GROUP BY {b}k, query_id, gold_units)"""


_M = ("hit_rate", "recall", "full_recall", "precision", "mrr", "ndcg")
_R9 = ", ".join(f"round({m}, 9) AS {m}" for m in _M)
_AVG = ", ".join(f"round(avg({m}), 4) AS {m}" for m in _M)
HITS = "hits AS (SELECT query_id, chunk_id, chunk_id AS unit_id, score, rank FROM br WHERE rank <= 10)"
BASE = f"{LEX}, {QUESTIONS}, {HITS}"
MODES = f"""{LEX}, {DENSE}, {fused([DEFAULT.kind_weight])}, {QUESTIONS},
modes AS (SELECT 'bm25' AS mode, query_id, chunk_id AS unit_id, rank FROM br WHERE rank <= 10 UNION ALL SELECT 'dense', query_id, chunk_id, rank FROM dr WHERE rank <= 10 UNION ALL SELECT 'hybrid', query_id, chunk_id, rank FROM fr WHERE rank <= 10)"""
ANSWERS = f"""answers AS (SELECT query_id, CASE WHEN query_id % 5 = 0 THEN '{DEFAULT.abstain}' ELSE 'As in [Article ' || query_id || ' - x] and 【ANNEX III】, [Recital (' || query_id % 4 || ')]; again [Article ' || query_id || '].' END AS answer,
  'vendor' || query_id % 3 || '/model' AS model, ['correct', 'partial', 'incorrect', 'unscored'][query_id % 4 + 1] AS jg, CASE WHEN query_id % 3 = 0 THEN 1.0::DOUBLE ELSE 0.5 END AS jf, (query_id % 10)::DOUBLE / 4 AS latency_s,
  CASE WHEN query_id % 5 = 0 THEN []::VARCHAR[] ELSE ['art_' || query_id, 'anx_III', 'rct_' || query_id % 4] END AS cited FROM asked WHERE query_id % 7 <> 6)"""
ROWS = f"""{BASE}, {ANSWERS}, {scores("hits", [K])},
ret AS (SELECT query_id, list('art_' || unit_id ORDER BY rank) AS ret FROM hits WHERE rank <= {K} GROUP BY 1),
er0 AS (SELECT q.*, a.*, coalesce(ret, []::VARCHAR[]) AS retrieved, answer = '{DEFAULT.abstain}' AS abstained, hit_rate, full_recall FROM questions q JOIN answers a USING (query_id) LEFT JOIN sc USING (query_id) LEFT JOIN ret USING (query_id)),
er1 AS (SELECT *, CASE WHEN type = 'unanswerable' THEN CASE WHEN abstained THEN 'correct' ELSE 'incorrect' END WHEN abstained THEN 'incorrect' ELSE jg END AS grade,
  CASE WHEN type <> 'unanswerable' AND NOT abstained THEN jf END AS faithfulness, CASE WHEN type <> 'unanswerable' AND NOT abstained THEN 2 ELSE 0 END AS n_claims,
  CASE WHEN len(cited) > 0 THEN len(list_filter(cited, lambda c: list_contains(retrieved, c)))::DOUBLE / len(cited) END AS citation_validity FROM er0),
er AS (SELECT *, CASE WHEN type = 'unanswerable' THEN CASE WHEN abstained THEN 'ok' ELSE 'hallucination_no_abstain' END WHEN coalesce(hit_rate, 0) = 0 THEN 'retrieval_miss' WHEN abstained THEN 'false_abstention'
  WHEN coalesce(full_recall, 0) = 0 AND type = 'multi_hop' THEN 'partial_retrieval' WHEN grade = 'incorrect' THEN 'generation_error' WHEN grade = 'partial' THEN 'incomplete_answer' ELSE 'ok' END AS failure FROM er1)"""
_GLOSS = ", ".join(f"('{a}', '{b}')" for a, b in report.GLOSS)
FAILURES = f"""{ROWS}, fl AS (SELECT failure, count(*) AS n, min(ord) AS f FROM er GROUP BY 1),
fp AS (SELECT fl.failure, n, coalesce(meaning, '') AS meaning, (row_number() OVER (ORDER BY n DESC, f))::INTEGER AS place FROM fl LEFT JOIN (VALUES {_GLOSS}) AS g(failure, meaning) USING (failure))"""


def _pct(c: str) -> str:
    return f"coalesce(printf('%.1f%%', {c} * 100), '—') AS {c}"


def _dec(c: str) -> str:
    return f"coalesce(printf('%.3f', {c}), '—') AS {c}"


def tokens(c: str) -> str:
    return f"(trunc(len(list_filter(string_split_regex({c}, '\\s+'), lambda w: w <> ''))::DOUBLE * 1.4::DOUBLE)::INTEGER + 1)"


def sentences(c: str) -> str:
    """RE2 has no look-behind: every boundary gets a mark, those after No. and Art. lose it again."""
    marked = f"regexp_replace({c}, '([.;:])\\s+([A-Z(\"''])', '\\1' || chr(1) || '\\2', 'g')"
    return f"string_split(regexp_replace({marked}, '\\b(No|Art)\\.' || chr(1), '\\1. ', 'g'), chr(1))"


def packed(source: str, joiner: str, budget: int = DEFAULT.max_chunk_tokens) -> str:
    """pk(id, pos, part): source(id, i, piece) packed one piece after another by a recursive query."""
    return f"""pc AS (SELECT id, i, piece, {tokens("piece")} AS t FROM {source}),
rc(id, i, grp, tok) AS (SELECT id, i, 0, t FROM pc WHERE i = 1 UNION ALL
  SELECT pc.id, pc.i, CASE WHEN tok + t > {budget} THEN grp + 1 ELSE grp END, CASE WHEN tok + t > {budget} THEN t ELSE tok + t END FROM rc JOIN pc ON pc.id = rc.id AND pc.i = rc.i + 1),
pk AS (SELECT id, grp AS pos, string_agg(piece, {joiner} ORDER BY pc.i) AS part FROM rc JOIN pc USING (id, i) GROUP BY ALL)"""


_LINES = "ln AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents)"
_MARK = r"^\s*(?:\d{1,3}\.|\(\d{1,3}\)|\([a-z]{1,3}\)|\([ivxlcdm]{1,7}\)|Section\s+[A-Z]\.)\s"
#: Chunks: atoms; of long atoms the packed sentences; those packed again; a short last part joined to the one before it.
CHUNKS = f"""{_LINES}, lg AS (SELECT *, sum(CASE WHEN p = 1 OR regexp_matches(line, '{_MARK}') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY p) AS a FROM ln),
atom AS (SELECT id, a, string_agg(line, chr(10) ORDER BY p) AS atom FROM lg GROUP BY ALL), fit AS (SELECT *, {tokens("atom")} <= {DEFAULT.max_chunk_tokens} AS fits FROM atom),
s0 AS (SELECT id * 100000 + a AS id, unnest({sentences("atom")}) AS piece, generate_subscripts({sentences("atom")}, 1) AS i FROM fit WHERE NOT fits),
{packed("s0", "' '").replace("pc AS", "pc1 AS", 1).replace(" pc ", " pc1 ").replace("pc.", "pc1.").replace("rc", "rc1").replace("pk AS", "pk1 AS")},
un AS (SELECT id, a, 0 AS pos, atom AS piece FROM fit WHERE fits UNION ALL SELECT id // 100000, id % 100000, pos, part FROM pk1),
s1 AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY a, pos) AS i, piece FROM un), {packed("s1", "chr(10)")},
pn AS (SELECT *, max(pos) OVER (PARTITION BY id) AS last FROM pk),
rt AS (SELECT id FROM pn WHERE pos = last AND last > 0 AND {tokens("part")} < {DEFAULT.min_chunk_tokens}),
fd AS (SELECT id, CASE WHEN id IN (SELECT id FROM rt) THEN least(pos, last - 1) ELSE pos END AS pos, CASE WHEN id IN (SELECT id FROM rt) THEN last ELSE last + 1 END AS n, string_agg(part, chr(10) ORDER BY pos) AS part FROM pn GROUP BY 1, 2, 3),
bd AS (SELECT id, (pos + 1)::INTEGER AS part, n::INTEGER AS n_parts, regexp_replace(regexp_replace(part, '^\\s+', ''), '\\s+$', '') AS body FROM fd),
chunks AS (SELECT 'doc_' || id || CASE WHEN n_parts = 1 THEN '' ELSE '#p' || part END AS chunk_id, {_KIND} AS kind, 'doc_' || id AS unit_id, 'Document ' || id AS citation, part, n_parts, body,
  '[' || source || ' > ' || lang || '] Document ' || id || CASE WHEN n_parts > 1 THEN ' (part ' || part || ' of ' || n_parts || ')' ELSE '' END || chr(10) || body AS text, '{BASE_URL}#doc_' || id AS url FROM bd JOIN documents ON doc_id = id),
ct AS (SELECT *, {tokens("text")} AS n_tokens FROM chunks)"""
RECURSIVE = "WITH RECURSIVE "

_CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate({0}, chr(160) || '’‘“”', ' ''''""'), '[ \t]+', ' ', 'g'), '^\s+', ''), '\s+$', ''), '(\d)\s+\^(\d)', '\1^\2', 'g')"""
_BARE = r"regexp_replace(html, '(?is)<(?:script\b.*?</script>|style\b.*?</style>|!--.*?-->)', '', 'g')"
_NEXT = r"<(h1|p|li|div|/h1|/p|/li|/div|/article|footer)\b"
_NAMED = ("lt", "<"), ("gt", ">"), ("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")


def _decoded(c: str) -> str:
    """The references that pages have; the ampersand last, as it may build others. A last one may lack its semicolon."""
    for name, sign in _NAMED:
        c = f"regexp_replace({c}, '&{name}{';?' if name == 'amp' else ';'}', '{sign}', 'g')"
    return c


_RAW = "regexp_replace(regexp_replace(x, '(?is)^<[^>]*>', ''), '<[^>]*>', ' ', 'g')"
_TEXT = f"regexp_replace({_RAW}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')"
#: No look-ahead in RE2: the page is cut at every mark that opens or ends a block, and the cuts that a block opens are kept.
BLOCKS = rf"""cut AS (SELECT page_id, string_split(regexp_replace({_BARE}, '(?i){_NEXT}', chr(2) || '\0', 'g'), chr(2)) AS c FROM pages),
pce AS (SELECT page_id, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM cut), op AS (SELECT *, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INTEGER AS pos FROM pce WHERE regexp_matches(x, '(?is)^<(h1|p|li|div)\b[^>]*>')),
blocks AS (SELECT page_id, pos, lower(regexp_extract(x, '(?is)^<(h1|p|li|div)\b', 1)) AS tag, regexp_extract(x, '(?is)^<[^>]*\sclass="([^"]*)"', 1) AS classes, regexp_extract(x, '(?is)^<[^>]*\sid="([^"]*)"', 1) AS element_id, {_CLEAN.format(_decoded(_TEXT))} AS text FROM op)"""
#: Every piece between two marks is a line of the page's outline: elements without tables, so nothing is indented.
_LINES = f"""bod AS (SELECT page_id, string_split(regexp_replace(regexp_replace({_BARE}, '(?is)^.*<body>', ''), '(?i){_NEXT}', chr(2) || '\\0', 'g'), chr(2)) AS c FROM pages),
lin AS (SELECT page_id, i, t FROM (SELECT page_id, i, {_CLEAN.format(_decoded(_RAW))} AS t FROM (SELECT page_id, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM bod)) WHERE t <> '')"""
_PAGE_TEXT = "SELECT page_id, string_agg(t, chr(10) ORDER BY i) AS text FROM lin GROUP BY 1"
_UNITS = [
    (1, "art_1", "article", "Article 1 - Scope", "Scope", "CHAPTER I", "CHAPTER I - General & first", "1. This <rule> holds.\n2. Also—here."),
    (1, "art_2", "article", "Article 2", "", "CHAPTER I", "CHAPTER I - General & first", "Only a body."),
    (1, "anx_I", "annex", "ANNEX I - Lists", "Lists", "Annexes", "Annexes", "(a) one"),
    (2, "rct_3", "recital", "Recital (3)", "", "Recitals", "Recitals (non-binding interpretive context)", "Whereas x."),
]

_USERS = "u AS (SELECT DISTINCT user_id, ['groq', 'openai', 'gemini', 'ollama', 'nobody'][user_id % 5 + 1] AS provider FROM events)"
_ASOF = """l AS (SELECT event_id, user_id, ts, floor(abs(value))::BIGINT AS t FROM events), s AS (SELECT user_id, ts, max(event_id % 200 + 100) AS lim FROM events WHERE event_id % 7 = 0 GROUP BY ALL),
a AS (SELECT l.*, s.lim FROM l ASOF LEFT JOIN s ON l.user_id = s.user_id AND l.ts > s.ts)"""

O: dict[str, str] = {
    "scan_pages": "SELECT page_id, url, length(html) AS n_chars, contains(html, '<article') AS has_article FROM pages",
    "scan_chunks": f"WITH {CORPUS} SELECT chunk_id, kind, length(text) AS n_chars FROM corpus",
    "scan_queries": f"WITH {QUESTIONS} SELECT query_id, question, type, array_to_string(gold_units, ',') AS gold FROM questions",
    "provider_lookup": f"""WITH {_USERS} SELECT user_id, provider, base_url, key_variable, key_variable IS NOT NULL AS needs_key FROM u JOIN (VALUES """ + ", ".join(f"('{p}', '{u}', {repr(k) if k else 'NULL'})" for p, u, k in ratelimit.PROVIDERS) + f""") AS v(provider, base_url, key_variable) USING (provider)
UNION ALL SELECT user_id, provider, NULL, NULL, NULL FROM u WHERE provider = 'nobody'""",
    "report_lines": f"WITH {FAILURES} SELECT string_agg('| ' || failure || ' | ' || n || ' | ' || meaning || ' |', chr(10) ORDER BY place) AS body FROM fp",
    "clean_text": f"SELECT id, md5({_CLEAN.format('s')}) AS cleaned_md5 FROM (SELECT -id::BIGINT AS id, s FROM {values('clean')} UNION ALL SELECT doc_id, text FROM documents)",
    "superscript_repair": rf"""SELECT id, CASE WHEN contains(html, 'oj-note-tag') THEN html ELSE regexp_replace(html, '(\d)(\s*)<span class="oj-super">\s*(\d+)\s*</span>', '\1\2^\3', 'g') END AS repaired FROM {values("supers")}""",
    "drop_blocks": f"SELECT doc, pos, text FROM {values('blocks')} WHERE NOT (contains(classes, 'oj-note') OR contains(classes, 'oj-ti-art') OR contains(classes, 'oj-sti-art') OR contains(classes, 'oj-doc-ti'))",
    "page_blocks": f"WITH {BLOCKS} SELECT * FROM blocks WHERE text <> ''",
    "page_text": f"WITH {_LINES} {_PAGE_TEXT}",
    "page_chunks": f"{RECURSIVE}{_LINES}, documents AS (SELECT page_id AS doc_id, text, 'page' AS source, 'html' AS lang FROM ({_PAGE_TEXT})), {CHUNKS} SELECT chunk_id, unit_id, part, n_parts, body, text, n_tokens FROM ct",
    "page_units": f"""WITH pages AS (SELECT page_id, html, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS art FROM pages), {_LINES.replace("pages)", "(SELECT page_id, art AS html FROM pages))")},
lnk AS (SELECT page_id, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1) AS ls FROM pages), one AS (SELECT page_id, unnest(ls) AS x, generate_subscripts(ls, 1) - 1 AS i FROM lnk),
rws AS (SELECT page_id, string_agg('(' || i || ') ' || {_CLEAN.format(_decoded("x"))} || CASE WHEN i % 2 = 0 THEN chr(10) || repeat(' ', 8) || '(a) 10^' || i || ' x' || chr(10) || repeat(' ', 20) || 'second' || chr(10) || repeat(' ', 8) || '1 2 3' ELSE '' END, chr(10) ORDER BY i) AS r FROM one GROUP BY 1)
SELECT page_id, 'art_' || page_id AS unit_id, 'article' AS kind, 'Article ' || page_id || ' - Links' AS citation, 'Links' AS title, 'Chapter ' || page_id AS chapter, 'Chapter ' || page_id || ' - Pages' AS chapter_title, '{BASE_URL}#art_' || page_id AS url,
  concat_ws(chr(10), t.text, r, 'after', 'inner', 'tail') AS body FROM pages LEFT JOIN ({_PAGE_TEXT}) t USING (page_id) LEFT JOIN rws USING (page_id)
UNION ALL SELECT * FROM (VALUES """ + ", ".join("(" + ", ".join([str(-p), *(_literal(x) for x in (i, k, c, t, ch, ct, f"{BASE_URL}#{i}", b))]) + ")" for p, i, k, c, t, ch, ct, b in _UNITS) + ") AS v(page_id, unit_id, kind, citation, title, chapter, chapter_title, url, body)",
    "heading_ffill": f"""WITH b AS (SELECT *, contains(classes, 'oj-ti-section-1') AS h, upper(text) LIKE 'CHAPTER%' AS c, upper(text) LIKE 'SECTION%' AS s, contains(classes, 'oj-ti-section-2') AS t FROM {values("blocks")}),
p AS (SELECT *, max(CASE WHEN h AND c THEN pos END) OVER w AS cp, max(CASE WHEN h AND s THEN pos END) OVER w AS sp FROM b WINDOW w AS (PARTITION BY doc ORDER BY pos)),
q AS (SELECT *, CASE WHEN sp > coalesce(cp, 0) THEN sp END AS own FROM p),
n AS (SELECT doc, coalesce(own, cp) AS head, min(pos) AS tp, arg_min(text, pos) AS title FROM q WHERE t AND NOT h GROUP BY ALL)
SELECT q.doc, q.pos, coalesce(ch.text, '') AS chapter, coalesce(CASE WHEN cn.tp <= q.pos THEN ch.text || ' - ' || cn.title END, '') AS chapter_title, coalesce(se.text, '') AS section, coalesce(CASE WHEN sn.tp <= q.pos THEN se.text || ' - ' || sn.title END, '') AS section_title
FROM q LEFT JOIN b ch ON ch.doc = q.doc AND ch.pos = q.cp LEFT JOIN b se ON se.doc = q.doc AND se.pos = q.own LEFT JOIN n cn ON cn.doc = q.doc AND cn.head = q.cp LEFT JOIN n sn ON sn.doc = q.doc AND sn.head = q.own""",
    "route_kind": f"SELECT * FROM (SELECT *, CASE WHEN contains(classes, 'eli-subdivision') AND starts_with(element_id, 'art_') THEN 'article' WHEN contains(classes, 'eli-subdivision') AND starts_with(element_id, 'rct_') THEN 'recital' WHEN contains(classes, 'eli-container') AND starts_with(element_id, 'anx_') THEN 'annex' END AS kind FROM {values('kinds')}) WHERE kind IS NOT NULL",
    "unit_projection": f"""WITH u AS (SELECT *, split_part(element_id, '_', 2) AS number, CASE kind WHEN 'recital' THEN '' WHEN 'article' THEN rtrim(coalesce(title, ''), '`') ELSE coalesce(title, '') END AS t FROM {values("units")})
SELECT element_id AS unit_id, kind, CASE kind WHEN 'recital' THEN 'Recital (' || number || ')' ELSE coalesce(label, CASE kind WHEN 'article' THEN 'Article ' ELSE 'ANNEX ' END || number) || CASE WHEN t <> '' THEN ' - ' || t ELSE '' END END AS citation, t AS title,
  CASE kind WHEN 'recital' THEN 'Recitals' WHEN 'annex' THEN 'Annexes' ELSE chapter END AS chapter, CASE kind WHEN 'recital' THEN 'Recitals (non-binding interpretive context)' WHEN 'annex' THEN 'Annexes' ELSE chapter_title END AS chapter_title,
  CASE kind WHEN 'article' THEN section ELSE '' END AS section, CASE kind WHEN 'article' THEN section_title ELSE '' END AS section_title, CASE kind WHEN 'recital' THEN trim(regexp_replace(body, '^\\(\\d+\\)\\s*', '')) ELSE body END AS body, '{BASE_URL}#' || element_id AS url, number FROM u""",
    "approx_tokens": f"SELECT doc_id, {tokens('text')} AS n_tokens FROM documents",
    "enumerated_atoms": f"""WITH ln AS (SELECT id, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS p FROM (SELECT -id::BIGINT AS id, body FROM {values("atoms")} UNION ALL SELECT doc_id, text FROM documents)),
lg AS (SELECT *, sum(CASE WHEN p = 1 OR regexp_matches(line, '{_MARK}') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY p) AS a FROM ln) SELECT id, (a - 1)::INTEGER AS pos, string_agg(line, chr(10) ORDER BY p) AS atom FROM lg GROUP BY id, a""",
    "sentence_split": f"WITH x AS (SELECT -id::BIGINT AS id, body FROM {values('sentences')} UNION ALL SELECT doc_id, text FROM documents) SELECT id, unnest({sentences('body')}) AS sentence, (generate_subscripts({sentences('body')}, 1) - 1)::INTEGER AS pos FROM x",
    "pack_sentences": f"{RECURSIVE} s AS (SELECT doc_id AS id, unnest({sentences('text')}) AS piece, generate_subscripts({sentences('text')}, 1) AS i FROM documents), {packed('s', repr(' '))} SELECT id AS doc_id, pos::INTEGER AS pos, part FROM pk",
    "chunk_documents": f"{RECURSIVE}{CHUNKS} SELECT chunk_id, unit_id, part, n_parts, body, text, n_tokens FROM ct",
    "breadcrumb": f"SELECT id, CASE WHEN h <> '' THEN '[' || h || '] ' ELSE '' END || citation || CASE WHEN n_parts > 1 THEN ' (part ' || part || ' of ' || n_parts || ')' ELSE '' END || chr(10) AS crumb FROM (SELECT *, concat_ws(' > ', nullif(chapter, ''), nullif(section, '')) AS h FROM {values('crumbs')})",
    "corpus_stats": f"""{RECURSIVE}{CHUNKS}, so AS (SELECT list(n_tokens ORDER BY n_tokens) AS l, count(*) AS n FROM ct) SELECT 'chunks' AS metric, count(*) AS value FROM ct UNION ALL SELECT 'units', count(DISTINCT unit_id) FROM ct UNION ALL SELECT 'kind:' || kind, count(*) FROM ct GROUP BY kind
UNION ALL SELECT 'tokens_min', l[1] FROM so UNION ALL SELECT 'tokens_p50', l[n // 2 + 1] FROM so UNION ALL SELECT 'tokens_p95', l[trunc(n * 0.95::DOUBLE)::BIGINT + 1] FROM so UNION ALL SELECT 'tokens_max', l[n] FROM so""",
    "tokenize": f"SELECT doc_id, len({TOKENS.format('text')}) AS n, md5(array_to_string({TOKENS.format('text')}, ' ')) AS digest FROM documents",
    "l2_normalize": "WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE * 3 AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings), n AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM e GROUP BY 1) SELECT vec_id, pos::INTEGER AS pos, round(x / n, 6) AS x FROM e JOIN n USING (vec_id)",
    "index_projection": f"{RECURSIVE}{CHUNKS} SELECT chunk_id, text, kind, unit_id, citation, '' AS title, '' AS chapter_title, '' AS section_title, part, n_parts, url, n_tokens FROM ct",
    "index_no_recitals": f"WITH {CORPUS} SELECT chunk_id, kind FROM corpus WHERE kind <> 'recital'",
    "bm25_index_stats": f"WITH {CORPUS}, {TERMS} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "bm25_topk": f"WITH {LEX} SELECT * FROM br WHERE rank <= 10",
    "bm25_topk_segments": f"WITH {LEX.replace('FROM documents)', 'FROM documents WHERE doc_id % 10 <> 3)')} SELECT * FROM br WHERE rank <= 10",
    "bm25_topk_blocks": f"WITH {LEX} SELECT * FROM br WHERE rank <= 10",
    "bm25_topk_padded": f"""WITH {CORPUS}, {TERMS}, asked AS (SELECT item_id AS query_id, text AS question FROM benchmark UNION ALL SELECT -1 - item_id, ({TOKENS.format("text")})[-1] FROM benchmark UNION ALL SELECT -1000000, 'zzzzqq'), {bm25("asked")},
p AS (SELECT a.query_id, c.chunk_id, coalesce(score, 0) AS score FROM asked a CROSS JOIN corpus c LEFT JOIN bs ON bs.query_id = a.query_id AND bs.chunk_id = c.chunk_id),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id))::INTEGER AS rank FROM p) SELECT * FROM r WHERE rank <= 10""",
    "dense_topk": """WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id))::INTEGER AS rank FROM s) SELECT * FROM r WHERE rank <= 10""",
    "hit_projection": f"WITH {LEX} SELECT query_id, chunk_id, md5(text) AS text, score, rank, kind, 'doc_' || chunk_id AS unit_id, 'Document ' || chunk_id AS citation, NULL::VARCHAR AS chapter_title, '{BASE_URL}#doc_' || chunk_id AS url FROM br JOIN corpus USING (chunk_id) WHERE rank <= 10",
    "rrf_hybrid": f"WITH {LEX}, {DENSE}, {fused([1.0])} SELECT query_id, chunk_id, score, rank FROM fr WHERE rank <= {K}",
    "rrf_weighted": f"WITH {LEX}, {DENSE}, {fused([DEFAULT.kind_weight])} SELECT query_id, chunk_id, score, rank FROM fr WHERE rank <= {K}",
    "rrf_drop_kind": f"WITH {LEX}, {DENSE}, {fused([0.0])} SELECT query_id, chunk_id, score, rank FROM fr WHERE rank <= {K}",
    "parse_citations": f"SELECT id, array_to_string(list_transform(list_filter(list_zip(l, range(1, len(l) + 1)), lambda x: list_position(l, x[1]) = x[2]), lambda x: x[1]), ',') AS units FROM (SELECT id, list_transform(list_zip(regexp_extract_all(answer, '{CITATION}', 1), regexp_extract_all(answer, '{CITATION}', 2)), lambda z: CASE lower(z[1]) WHEN 'article' THEN 'art_' || z[2] WHEN 'annex' THEN 'anx_' || upper(z[2]) ELSE 'rct_' || z[2] END) AS l FROM {values('answers')})",
    "abstained": f"WITH {ASKED}, {ANSWERS} SELECT query_id, contains(answer, '{DEFAULT.abstain}') AS abstained FROM answers",
    "retrieved_units": f"WITH {BASE}, u AS (SELECT query_id, unit_id // 20 AS u, min(rank) AS r FROM hits GROUP BY ALL) SELECT query_id, string_agg(u::VARCHAR, ',' ORDER BY r) AS units FROM u GROUP BY 1",
    "answer_join": f"WITH {ASKED}, {ANSWERS} SELECT query_id, coalesce(answer, 'No answer source is configured; these are the retrieved passages only.') AS answer, coalesce(model, 'extractive') AS model, coalesce(contains(answer, '{DEFAULT.abstain}'), false) AS abstained, coalesce(array_to_string(cited, ','), '') AS cited FROM asked LEFT JOIN answers USING (query_id)",
    "fabricated_citations": f"WITH {ROWS} SELECT query_id, coalesce(array_to_string(list_filter(cited, lambda c: NOT list_contains(retrieved, c)), ','), '') AS fabricated FROM er",
    "passage_preview": "SELECT doc_id, md5(CASE WHEN length(b) > 2400 THEN substr(b, 1, 2400) || '…' ELSE b END) AS preview_md5 FROM (SELECT doc_id, CASE WHEN contains(text, chr(10)) THEN substr(text, strpos(text, chr(10)) + 1) ELSE text END AS b FROM documents)",
    "config_drift": f"SELECT setting, r.value AS running, m.value AS measured FROM {values('running')} r JOIN {values('measured')} m USING (setting) WHERE r.value IS DISTINCT FROM m.value",
    "estimate_tokens": "SELECT conv_id, (trunc(coalesce(sum(length(text)), 0)::DOUBLE / 3.5::DOUBLE) + 2500)::BIGINT AS estimate FROM conversations GROUP BY 1",
    "asof_limit": f"WITH {_ASOF} SELECT event_id, lim AS \"limit\" FROM a",
    "asof_token_budget": f"""WITH {_ASOF}, w AS (SELECT event_id, t, lim, sum(t) OVER f AS s, count(*) OVER f AS c FROM a WINDOW f AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW))
SELECT event_id, (s - t)::BIGINT AS spent, c > 1 AND s > coalesce(lim, 120.0)::DOUBLE * {DEFAULT.usage_fraction} AS would_block FROM w""",
    # one step of the recursion lets the next call of each model go, or lets it wait once
    "admission_times": f"""WITH RECURSIVE c AS (SELECT user_id, event_id, epoch_us(ts) AS ts, floor(abs(value))::BIGINT AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r(user_id, i, now, spent, event_id, gone) AS (SELECT user_id, 1::BIGINT, ts, []::STRUCT(a BIGINT, t BIGINT)[], NULL::BIGINT, NULL::BIGINT FROM c WHERE i = 1
UNION ALL SELECT user_id, CASE WHEN ok THEN i + 1 ELSE i END, CASE WHEN ok THEN greatest(now, coalesce(later, now)) ELSE now + 86400000000 - (now - d[1].a) + 250000 END, CASE WHEN ok THEN list_append(d, {{'a': now, 't': t}}) ELSE d END, CASE WHEN ok THEN event_id END, CASE WHEN ok THEN now END
FROM (SELECT x.*, n.ts AS later, len(d) = 0 OR list_sum(list_transform(d, lambda y: y.t)) + x.t <= 200.0 * {DEFAULT.usage_fraction} AS ok
  FROM (SELECT r.user_id, r.i, r.now, c.event_id, c.t, list_filter(r.spent, lambda y: NOT r.now - y.a > 86400000000) AS d FROM r JOIN c ON c.user_id = r.user_id AND c.i = r.i) x LEFT JOIN c n ON n.user_id = x.user_id AND n.i = x.i + 1))
SELECT event_id, gone AS admitted FROM r WHERE event_id IS NOT NULL""",
    "rolling_token_budget": """WITH l AS (SELECT event_id, user_id, ts, floor(abs(value))::BIGINT AS t FROM events), w AS (SELECT event_id, t, sum(t) OVER f AS s, count(*) OVER f AS c FROM l WINDOW f AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW))
SELECT event_id, (s - t)::BIGINT AS spent, c > 1 AND s > 120 * 0.75 AS would_block FROM w""",
    "learnt_token_budget": """WITH l AS (SELECT event_id, user_id, ts, floor(abs(value))::BIGINT AS t FROM events), m AS (SELECT user_id, max(t) AS most FROM l WHERE user_id % 2 = 0 GROUP BY 1),
w AS (SELECT event_id, user_id, t, sum(t) OVER f AS s, count(*) OVER f AS c FROM l WINDOW f AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW))
SELECT event_id, (s - t)::BIGINT AS spent, c > 1 AND s > coalesce(most, 120) * 0.75 AS would_block FROM w LEFT JOIN m USING (user_id)""",
    "retry_schedule": f"SELECT id, a::INTEGER AS attempt, CASE WHEN id = 3 THEN 7.5::DOUBLE ELSE least(2 * 2::DOUBLE ** a + 0.5, 120) END AS wait FROM {values('statuses')}, range(8) AS r(a) WHERE status = 429 OR status >= 500",
    "available_providers": f"WITH {_USERS} SELECT user_id, provider, provider IN ('groq', 'ollama') AS there FROM u",
    "cited_hits": f"WITH {BASE} SELECT query_id, rank, unit_id = query_id AND query_id % 5 > 0 AS cited FROM hits WHERE rank <= {K}",
    "coverage_banner": f"WITH {QUESTIONS}, {ASKED}, {ANSWERS}, c AS (SELECT count(a.query_id) AS n, count(*) AS m, string_agg(q.query_id::VARCHAR, ',' ORDER BY ord) FILTER (WHERE a.query_id IS NULL) AS x FROM questions q LEFT JOIN answers a ON a.query_id = q.query_id) SELECT 'Partial run: ' || n || ' of ' || m || ' questions scored; missing: ' || x AS line FROM c WHERE n < m",
    "parse_duration": f"""SELECT id, round(CASE WHEN s LIKE '%ms' THEN coalesce(try_cast(regexp_extract(s, '^(.*)ms$', 1) AS DOUBLE), 0) / 1000 WHEN regexp_matches(s, '^(?:(\\d+)h)?(?:(\\d+)m)?(?:([\\d.]+)s)?$')
  THEN coalesce(try_cast(regexp_extract(s, '^(\\d+)h', 1) AS DOUBLE), 0) * 3600 + coalesce(try_cast(regexp_extract(s, '(?:^|h)(\\d+)m', 1) AS DOUBLE), 0) * 60 + coalesce(try_cast(regexp_extract(s, '(?:^|h|m)([\\d.]+)s$', 1) AS DOUBLE), 0) ELSE 0 END, 6) AS seconds FROM (SELECT id, trim(coalesce(s, '')) AS s FROM {values("durations")})""",
    "latest_limit": "SELECT user_id AS model, arg_max(event_id, {'ts': ts, 'event_id': event_id}) AS limit FROM events WHERE event_id % 3 > 0 GROUP BY 1".replace("AS limit", 'AS "limit"'),
    "classify_status": f"""SELECT id, CASE WHEN status = 429 AND regexp_matches(body, 'per day|TPD') THEN 'daily_quota' WHEN status = 429 OR status >= 500 THEN 'retry' WHEN status >= 400 THEN 'error' ELSE 'ok' END AS class, CASE WHEN status = 429 AND regexp_matches(body, 'per day|TPD') THEN round((coalesce(try_cast(regexp_extract(body, 'try again in (\\d+)m', 1) AS DOUBLE), 0) * 60 + coalesce(try_cast(regexp_extract(body, 'try again in (?:\\d+m)?([\\d.]+)s', 1) AS DOUBLE), 0)) / 60, 4) END AS minutes FROM {values("statuses")}""",
    "topk_units": f"WITH {BASE}, u AS (SELECT query_id, unit_id // 20 AS unit_id, min(rank) AS r FROM hits WHERE rank <= {K} GROUP BY ALL) SELECT query_id, unit_id, (row_number() OVER (PARTITION BY query_id ORDER BY r))::INTEGER AS unit_rank FROM u",
    "retrieval_metrics": f"WITH {MODES}, {scores('modes', [K], 'mode')} SELECT mode, k, query_id, {_R9} FROM sc",
    "citation_validity": f"WITH {ROWS} SELECT query_id, round(citation_validity, 9) AS citation_validity FROM er",
    "answerable": f"WITH {QUESTIONS} SELECT query_id, type FROM questions WHERE len(gold_units) > 0",
    "metrics_at_k": f"WITH {BASE}, {scores('hits', KS)} SELECT k, query_id, {_R9} FROM sc",
    "mean_metrics": f"WITH {MODES}, {scores('modes', KS, 'mode')} SELECT mode, k, {_AVG} FROM sc GROUP BY ALL",
    "metrics_by_type": f"WITH {MODES}, {scores('modes', [K], 'mode')} SELECT mode, k, coalesce(type, 'overall') AS type, {_AVG} FROM sc JOIN questions USING (query_id) GROUP BY GROUPING SETS ((mode, k), (mode, k, type))",
    "failure_taxonomy": f"WITH {ROWS} SELECT query_id, type, grade, failure FROM er",
    "grade_rows": f"WITH {ROWS} SELECT query_id, grade, round(faithfulness, 9) AS faithfulness, n_claims FROM er",
    "models_from": f"WITH {ROWS} SELECT string_agg(DISTINCT model, ' + ' ORDER BY model) AS gen_model, string_agg(DISTINCT CASE WHEN query_id % 2 = 0 THEN 'judge/a' ELSE 'unknown' END, ' + ' ORDER BY CASE WHEN query_id % 2 = 0 THEN 'judge/a' ELSE 'unknown' END) AS judge_model FROM er",
    "resume_pending": f"WITH {QUESTIONS}, {ASKED}, {ANSWERS} SELECT query_id, type FROM questions WHERE query_id NOT IN (SELECT query_id FROM answers)",
    "reorder_rows": f"WITH {QUESTIONS}, {ASKED}, {ANSWERS}, r AS (SELECT CASE WHEN query_id % 9 = 0 THEN query_id + 100000 ELSE query_id END AS query_id FROM answers) SELECT query_id, coalesce(ord, 1000000000) AS position FROM r LEFT JOIN questions USING (query_id)",
    "eval_summary": f"""WITH {ROWS} SELECT count(*) AS n, round(avg((grade = 'correct')::INT) FILTER (WHERE type <> 'unanswerable' AND grade <> 'unscored'), 4) AS answer_accuracy_strict, round(avg((grade IN ('correct', 'partial'))::INT) FILTER (WHERE type <> 'unanswerable' AND grade <> 'unscored'), 4) AS answer_accuracy_lenient,
  round(avg(faithfulness) FILTER (WHERE type <> 'unanswerable'), 4) AS faithfulness, round(avg(citation_validity), 4) AS citation_validity, round(avg(abstained::INT) FILTER (WHERE type = 'unanswerable'), 4) AS correct_abstention_rate, round(avg(abstained::INT) FILTER (WHERE type <> 'unanswerable'), 4) AS false_abstention_rate,
  round(avg((NOT abstained)::INT) FILTER (WHERE type = 'unanswerable'), 4) AS hallucination_rate_unanswerable, round(avg(latency_s), 4) AS mean_latency_s FROM er""",
    "summary_by_type": f"WITH {ROWS} SELECT t.type, count(er.query_id) AS n, round(avg((grade = 'correct')::INT), 4) AS accuracy_strict, round(avg(faithfulness), 4) AS faithfulness FROM (VALUES ('single_hop'), ('multi_hop'), ('unanswerable')) AS t(type) LEFT JOIN er ON er.type = t.type GROUP BY 1",
    "failure_modes": f"WITH {ROWS} SELECT failure, count(*) AS n FROM er GROUP BY 1",
    "coverage": f"WITH {QUESTIONS}, {ASKED}, {ANSWERS} SELECT count(a.query_id) AS scored, count(*) AS total, coalesce(string_agg(q.query_id::VARCHAR, ',' ORDER BY ord) FILTER (WHERE a.query_id IS NULL), '') AS missing FROM questions q LEFT JOIN answers a ON a.query_id = q.query_id",
    "ragas_input": f"WITH {ROWS} SELECT query_id, answer, CASE WHEN query_id % 2 = 0 THEN array_to_string(retrieved, '|') ELSE '' END AS contexts, question, reference FROM er WHERE type <> 'unanswerable' AND NOT abstained",
    "limit_queries": "SELECT item_id AS query_id, text AS question FROM benchmark ORDER BY item_id LIMIT 10",
    "model_family": f"SELECT model, lower(CASE WHEN contains(model, '/') THEN split_part(model, '/', 1) ELSE split_part(model, '-', 1) END) AS family FROM {values('models')}",
    "pick_judge": f"""WITH f AS (SELECT m.model, p.model AS judge, pos FROM {values("models")} m LEFT JOIN {values("preferences")} p ON lower(CASE WHEN contains(m.model, '/') THEN split_part(m.model, '/', 1) ELSE split_part(m.model, '-', 1) END) <> lower(CASE WHEN contains(p.model, '/') THEN split_part(p.model, '/', 1) ELSE split_part(p.model, '-', 1) END))
SELECT model, coalesce(arg_min(judge, pos), 'default/judge') AS judge FROM f GROUP BY 1""",
    "extract_json": rf"""WITH b AS (SELECT id, trim(regexp_replace(regexp_replace(trim(s, ' ' || chr(10)), '(?m)^```(?:json)?', '', 'g'), '(?m)```$', '', 'g'), ' ' || chr(10)) AS b FROM {values("judge_texts")}), i AS (SELECT *, regexp_extract(b, '(?s)[\[{{].*[\]}}]') AS i FROM b)
SELECT id, CASE WHEN b <> '' AND json_valid(b) THEN b WHEN i <> '' AND json_valid(i) THEN i END AS json FROM i""",
    "number_claims": f"SELECT id, array_to_string(list_transform(claims[1:20], lambda c, i: (i - 1) || '. ' || c), chr(10)) AS numbered FROM {values('claims')}",
    "faithfulness": f"""WITH v AS (SELECT id, CASE WHEN json_valid(s) THEN json_array_length(s) END AS n, CASE WHEN json_valid(s) THEN len(list_filter(json_extract_string(s, '$[*].supported'), lambda x: x = 'true')) END AS k FROM {values("verdicts")}) SELECT id, round(k::DOUBLE / nullif(n, 0), 9) AS score FROM v""",
    "unsupported_claims": f"""WITH v AS (SELECT id, unnest(json_extract(s, '$[*]')) AS x FROM {values("verdicts")} WHERE json_valid(s)) SELECT id, (x->>'claim_index')::INTEGER AS claim_index FROM v WHERE coalesce(x->>'supported', 'false') <> 'true'""",
    "validate_grade": f"SELECT id, CASE WHEN grade IN ('correct', 'partial', 'incorrect') THEN grade ELSE 'unscored' END AS grade FROM {values('grades')}",
    "fmt_metrics": f"SELECT id, {_pct('p')}, {_dec('d')} FROM {values('figures')}",
    "report_strategies": f"WITH {MODES}, {scores('modes', [K], 'mode')}, m AS (SELECT mode, {_AVG} FROM sc GROUP BY ALL) SELECT mode, {', '.join(map(_pct, _M[:4]))}, {', '.join(map(_dec, _M[4:]))} FROM m",
    "report_by_type": f"WITH {MODES}, {scores('modes', [K], 'mode')}, m AS (SELECT mode, type, {_AVG} FROM sc JOIN questions USING (query_id) GROUP BY ALL) SELECT mode, type, {', '.join(map(_pct, _M[:3]))}, {_dec('mrr')} FROM m",
    "report_k_pivot": f"WITH {MODES}, {scores('modes', KS, 'mode')}, m AS (SELECT mode, k, {_AVG} FROM sc GROUP BY ALL) SELECT mode, " + ", ".join(f"max(printf('%.1f%%', {c} * 100)) FILTER (WHERE k = {k}) AS {n}_at_{k}" for n, c in (("hit", "hit_rate"), ("full", "full_recall")) for k in KS) + " FROM m GROUP BY 1",
    "report_failures": f"WITH {FAILURES} SELECT * FROM fp",
    "report_failing": f"WITH {ROWS} SELECT query_id, type, failure, substr(replace(question, '|', '/'), 1, 90) AS question, 'because/' || CASE jg WHEN 'unscored' THEN 'odd' ELSE jg END AS why FROM er WHERE failure <> 'ok'",
    "report_unsupported": f"WITH {ROWS} SELECT query_id, 1 AS claim_index, 'no passage ' AS reason FROM er WHERE jf < 1 ORDER BY ord LIMIT 25",
}
for _m in _M:
    O[f"metric_{_m}"] = f"WITH {BASE}, {scores('hits', [K])} SELECT query_id, round({_m}, 9) AS {_m} FROM sc"
_SWEEP = f"WITH {LEX}, {DENSE}, {fused(WEIGHTS)}, {QUESTIONS}, sw AS (SELECT weight, query_id, chunk_id AS unit_id, rank FROM fr WHERE rank <= {K}), {scores('sw', [K], 'weight')}, m AS (SELECT weight, {_AVG} FROM sc GROUP BY ALL)"
O["ablation_weights"] = f"{_SWEEP} SELECT * FROM m"
O["report_ablation"] = f"{_SWEEP} SELECT weight::VARCHAR || CASE WHEN weight = {DEFAULT.kind_weight} THEN ' ←default' ELSE '' END AS w, {', '.join(map(_pct, _M[:3]))}, {', '.join(map(_dec, _M[4:]))} FROM m"
_CONTEXT = f"ctx AS (SELECT query_id, string_agg('[Document ' || chunk_id || ']' || chr(10) || CASE WHEN contains(text, chr(10)) THEN substr(text, strpos(text, chr(10)) + 1) ELSE text END, chr(10) || chr(10) ORDER BY rank) AS context FROM hits JOIN corpus USING (chunk_id) WHERE rank <= {K} GROUP BY 1)"
O["format_context"] = f"WITH {BASE}, {_CONTEXT} SELECT * FROM ctx"
O["build_prompt"] = f"WITH {BASE}, {_CONTEXT} SELECT query_id, md5('Answer from the passages only and cite each in square brackets. If they hold no answer, reply {DEFAULT.abstain}.' || chr(10) || chr(10) || 'Passages:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || question) AS prompt_md5 FROM ctx JOIN asked USING (query_id)"
ORACLE_SQL = O
