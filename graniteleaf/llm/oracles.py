"""SQL that DuckDB runs on the same tables, for the queries that SQL can express. Written apart from the Spark code, with closed forms where that has joins."""

from __future__ import annotations

from graniteleaf.llm import quality_rules as rules
from graniteleaf.llm.mixing import BITS, FINE, SEED

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Shards of op4, as its contract says.
SHARDS = 24
_WORD = r"[^\x20\x09-\x0D]+"

def _crc(byte: int) -> int:
    """The entry of a byte in the table of CRC-32 (reflected polynomial)."""
    for _ in range(8):
        byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
    return byte


def _crc_of(hexes: str) -> str:
    """CRC-32 of bytes as hex digits, folded over the bytes."""
    return f"xor(list_reduce(list_transform(regexp_extract_all({hexes}, '..'), lambda x: ('0x' || x)::BIGINT), lambda c, x: xor(c >> 8, list_extract({[_crc(i) for i in range(256)]}::BIGINT[], xor(c & 255, x) + 1)), 4294967295::BIGINT), 4294967295::BIGINT)"


#: DuckDB has no crc32: it is folded over the bytes. ntile() gives the cuts, larger shards first.
OP4 = f"""
WITH b AS (SELECT row_number() OVER () AS rid, doc_id, source, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT rid, doc_id, source, (length(h) // 2 + 8)::BIGINT AS size,
  xor(list_reduce(list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT), lambda c, x: xor(c >> 8, list_extract({[_crc(i) for i in range(256)]}::BIGINT[], xor(c & 255, x) + 1)), 4294967295::BIGINT), 4294967295::BIGINT) AS crc FROM b),
k AS (SELECT *, ('0x' || substr(md5('shard-7|' || coalesce(doc_id::VARCHAR, '~') || '|' || crc::VARCHAR || '|' || size::VARCHAR), 1, 15))::BIGINT AS key FROM c),
f AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, crc) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY source) AS part FROM k),
s AS (SELECT *, (ntile({SHARDS}) OVER w - 1)::INTEGER AS shard, row_number() OVER w AS place FROM f WINDOW w AS (ORDER BY part, source NULLS FIRST, key, doc_id NULLS FIRST, crc, rid))
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, shard, place - min(place) OVER (PARTITION BY shard) AS slot, NULL::INTEGER AS grown_shard FROM s
"""

OP5 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
e AS (SELECT rid, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), '{_UPPER}', '{_LOWER}') AS key FROM e),
hot AS (SELECT key AS hot FROM (SELECT DISTINCT rid, key FROM k) GROUP BY key HAVING count(*) >= 10 AND length(key) >= 1)
SELECT doc_id, count(*) AS n_lines, count(hot) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE hot IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN hot ON key = hot GROUP BY rid, doc_id
"""

_ESC = r"replace(replace(replace({0}, '\', '\b'), '#', '\h'), '<', '\l')"
OP6 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
o AS (SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
  4 + length(replace({_ESC.format("role")}, chr(10), '\\e')) + 1 + length({_ESC.format("text")}) + 8 AS chars FROM c
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
p AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS upto FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (WHERE role = 'assistant' OR pos = n)::BIGINT AS formatted_chars
FROM p GROUP BY conv_id
"""

OP7 = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size FROM documents),
h AS (SELECT *, ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '~') || '|' || size::VARCHAR), 1, 15))::BIGINT AS h FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, (sum(source_size) OVER ())::BIGINT AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / (sum(weight) OVER (ORDER BY 3 * source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM w),
t AS (SELECT *, least((3 * source_size)::DOUBLE, (max(level) OVER ()) * weight) AS target FROM l),
g AS (SELECT *, {BITS} + CASE WHEN source_size > 0 THEN greatest(ceil(log2(total::DOUBLE * {FINE} / (least(source_size::DOUBLE, target) * {2**BITS}))), 0)::INTEGER ELSE 0 END AS bits, sum(target) OVER (ORDER BY place) AS upto FROM t),
q AS (SELECT *, coalesce(lag(upto) OVER (ORDER BY place), 0) AS since, (1::HUGEINT << bits) AS points FROM g),
b AS (SELECT *, CASE WHEN total > 0 THEN least(floor(upto / total * points + 0.5)::HUGEINT, points) - least(floor(since / total * points + 0.5)::HUGEINT, points) ELSE 0 END AS slots,
  CASE WHEN total > 0 THEN (source_size::HUGEINT * points - 1) // total + 1 ELSE 1 END AS blocks FROM q),
r AS (SELECT *, (least(slots, 3 * blocks) // blocks)::BIGINT AS epochs, ((least(slots, 3 * blocks) % blocks) * total // points)::BIGINT AS head FROM b),
p AS (SELECT h.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM h)
SELECT doc_id, size, source_size, target, (CASE WHEN size = 0 THEN 0 ELSE epochs * size + greatest(least(first + size, head) - first, 0) END)::BIGINT AS taken
FROM p JOIN r ON p.source IS NOT DISTINCT FROM r.source
"""

#: The step of a rule is one more than the number of its cutoffs (which fall) that the value does not exceed.
_FIRST = "least(" + ", ".join(f"1 + len(list_filter({list(map(float, cs))}::DOUBLE[], lambda c: NOT {e.replace(' / ', '::DOUBLE / ')} > c))" for e, cs in rules.RULES.values()) + ")"
_P = rules.MAX_FALSE
OP9 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text, md5(coalesce(text, '')) AS same FROM documents),
a AS (SELECT rid, doc_id, lang, same, regexp_extract_all(text, '{_WORD}') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls,
  regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g') AS solid FROM d),
s AS (SELECT rid, doc_id, lang, same, len(ws)::BIGINT AS n_words, length(solid)::BIGINT AS word_chars, len(regexp_extract_all(solid, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  len(regexp_extract_all(solid, '!'))::BIGINT AS n_bangs, len(regexp_extract_all(solid, '\\p{{Lu}}'))::BIGINT AS n_capitals,
  len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines FROM a),
v AS (SELECT rid, unnest(range(1, len(ws) - 6)) AS i, ws FROM a),
x AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, array_to_string(ws[i:i+7], ' ')) AS c FROM v),
y AS (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS j FROM x WHERE c > 1),
z AS (SELECT rid, sum(least(8, coalesce(j - i, 8)))::BIGINT AS n_repeat_words FROM y GROUP BY rid),
f AS (SELECT s.*, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM s LEFT JOIN z USING (rid)),
ff AS (SELECT *, {_FIRST} AS first FROM f),
m AS (SELECT lang, max(quality) AS quality, min(first) AS first FROM ff JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY lang, same),
u AS (SELECT lang, step, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE quality = 1 AND first <= step) AS k, count(*) FILTER (WHERE quality = 0 AND first <= step) AS bad,
  (SELECT count(*) FROM (SELECT DISTINCT lang FROM m)) AS strata FROM m, range(1, {rules.STEPS + 1}) AS r(step) GROUP BY ALL),
o AS (SELECT *, good > 0 AND k < good * {_P}
  AND list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(good + 1) - lgamma(i + 1) - lgamma(good - i + 1) + i * ln({_P}) + (good - i) * ln(1 - {_P})))) <= {rules.DELTA} / strata AS passes FROM u),
p AS (SELECT * FROM o WHERE bad > 0 AND NOT EXISTS (SELECT 1 FROM o AS x WHERE x.lang IS NOT DISTINCT FROM o.lang AND x.step <= o.step AND NOT x.passes)),
c AS (SELECT lang, arg_max(step, bad * 100 - step) AS step FROM p GROUP BY lang),
e AS (SELECT ff.*, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed, coalesce(first <= step, false) AS above FROM ff LEFT JOIN c ON ff.lang IS NOT DISTINCT FROM c.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT above AS kept FROM e
"""

#: Near words by all ways of leaving a letter out; roots by following one form after the other.
OP11 = f"""
WITH RECURSIVE r AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), '{_UPPER}', '{_LOWER}') AS run FROM documents),
c AS (SELECT id, run, count(*) AS c FROM r WHERE length(run) >= 7 GROUP BY ALL),
h AS (SELECT run, c, {_crc_of("hex(encode(id || ':' || run))")} AS h FROM c),
k AS (SELECT c, CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM h),
v AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM k WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
a AS (SELECT word, unnest(range(length(word))) AS i FROM v),
f AS MATERIALIZED (SELECT word, i, left(word, i::INT) || substr(word, i::INT + 2) AS rest FROM a),
p AS MATERIALIZED (SELECT x.word AS a, y.word AS b FROM f AS x JOIN f AS y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
  UNION SELECT f.word, v.word FROM f JOIN v ON rest = v.word UNION SELECT v.word, f.word FROM f JOIN v ON rest = v.word),
b AS (SELECT a AS word, count(*) AS n_near, arg_min(v.word, (-v.n, v.word)) AS best, max(v.n) AS best_n FROM p JOIN v ON p.b = v.word GROUP BY a),
g AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best_n >= 10 * n THEN best END AS form, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n FROM v LEFT JOIN b USING (word)),
w AS (SELECT word, form AS root FROM g WHERE form IS NOT NULL UNION ALL SELECT w.word, g.form FROM w JOIN g ON w.root = g.word WHERE g.form IS NOT NULL),
z AS (SELECT w.word, w.root FROM w JOIN g ON w.root = g.word WHERE g.form IS NULL)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM g LEFT JOIN z USING (word)
"""

ORACLE_SQL = {"op4_sharding": OP4, "op5_line_dedup": OP5, "op6_chat_format": OP6, "op7_mixing": OP7, "op9_quality_rules": OP9, "op11_spelling": OP11}
