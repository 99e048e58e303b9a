"""One query for each retrieval and evaluation operator, over the driver's tables or literal fixtures."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graniteleaf.config import DEFAULT
from graniteleaf.functions import text as T
from graniteleaf.operators import chunking, encoder, evaluation, grounding, indexing, judging, metrics, parsing, postings, ratelimit, report, retrieval, segments, vector_index
from graniteleaf.plans import base
from graniteleaf.plans.fixtures import fixture
from graniteleaf.sources.tables import shared_dir, table
from graniteleaf.streaming import admission

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
KS, WEIGHTS, K = [3, 5, 6, 10], list(DEFAULT.weights), DEFAULT.top_k


def query(f):
    QUERIES[f.__name__] = f
    return f


def _doc(col: str = "text"):
    return F.col(col)


# sources and sinks


@query
def scan_pages(s, d):
    return table(s, d, "pages").select("page_id", "url", F.length("html").cast("long").alias("n_chars"), F.col("html").contains("<article").alias("has_article"))


@query
def scan_chunks(s, d):
    return base.corpus(s, d).select("chunk_id", "kind", F.length("text").cast("long").alias("n_chars"))


@query
def scan_queries(s, d):
    return base.questions(s, d).select("query_id", "question", "type", F.array_join(F.col("gold_units").cast("array<string>"), ",").alias("gold"))


def _users(s, d):
    """user_id, provider: the provider that each user of the events is with; some are with none that is known."""
    names = F.array(*[F.lit(p) for p in ("groq", "openai", "gemini", "ollama", "nobody")])
    return table(s, d, "events").select("user_id").distinct().withColumn("provider", F.get(names, (F.col("user_id") % 5).cast("int")))


@query
def provider_lookup(s, d):
    known = s.createDataFrame(list(ratelimit.PROVIDERS), "provider string, base_url string, key_variable string").withColumn("needs_key", F.col("key_variable").isNotNull())
    return _users(s, d).join(F.broadcast(known), "provider", "left").select("user_id", "provider", "base_url", "key_variable", "needs_key")


@query
def report_lines(s, d):
    rows = report.failures(base.eval_rows(s, d))
    lines = report.markdown_rows(rows, ["failure", "n", "meaning"], "place")
    return lines.agg(F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("l")).select(F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("body"))


# parsing


@query
def clean_text(s, d):
    lit = fixture(s, "clean").select((-F.col("id")).cast("long").alias("id"), T.clean_text(_doc("s")).alias("cleaned"))
    return lit.unionByName(table(s, d, "documents").select(F.col("doc_id").alias("id"), T.clean_text(_doc()).alias("cleaned"))).select("id", F.md5("cleaned").alias("cleaned_md5"))


@query
def superscript_repair(s, d):
    return fixture(s, "supers", d).select("id", T.repair_superscripts(_doc("html")).alias("repaired"))


@query
def drop_blocks(s, d):
    return parsing.drop_notes(fixture(s, "blocks", d)).select("doc", "pos", "text")


@query
def render_outline(s, d):
    return fixture(s, "outlines", d).select("id", parsing.render_outline("html").alias("outline"))


@query
def page_blocks(s, d):
    return parsing.page_blocks(table(s, d, "pages"))


@query
def page_text(s, d):
    """The outline of each page's body."""
    return parsing.page_outline(table(s, d, "pages"))


@query
def page_chunks(s, d):
    """From html to chunks: every page's text as a unit."""
    p = table(s, d, "pages").select("page_id", "html")
    u = parsing.page_outline(p).select(F.concat(F.lit("doc_"), F.col("page_id").cast("string")).alias("unit_id"), F.lit("article").alias("kind"), F.concat(F.lit("Document "), F.col("page_id").cast("string")).alias("citation"), *[F.lit(v).alias(c) for c, v in (("title", ""), ("chapter", "page"), ("chapter_title", ""), ("section", "html"), ("section_title", ""))], F.lit("").alias("url"), F.col("text").alias("body"))
    return chunking.chunk_units(u).select("chunk_id", "unit_id", "part", "n_parts", "body", "text", "n_tokens")


def _marked_up(pages):
    """Pages as marked-up documents: the article as a unit with heading and titles, its links as rows of a table, with tables inside, and text after closed elements."""
    links = F.regexp_extract_all("html", F.lit('<li><a href="[^"]*">([^<]*)</a></li>'), F.lit(1))
    inner = lambda i: F.concat(F.lit('<table><tr><td>(a)</td><td><p>10<span class="oj-super">'), i.cast("string"), F.lit("</span> x</p><p>second</p></td></tr><tr><td>1<td>2<td>3</table>"))
    row = lambda x, i: F.concat(F.lit("<tr><td><p>("), i.cast("string"), F.lit(")</p></td><td>"), F.when(i % 3 == 0, x).otherwise(F.concat(F.lit("<p>"), x, F.lit("</p>"))), F.when(i % 2 == 0, inner(i)).otherwise(""), F.lit("</td></tr>"))
    n = F.col("page_id").cast("string")
    return pages.select("page_id", F.concat(
        F.lit('<div class="eli-container"><p class="oj-ti-section-1">Chapter '), n, F.lit('</p><p class="oj-ti-section-2">Pages</p><div class="eli-subdivision" id="art_'), n, F.lit('"><p class="oj-ti-art">Article '), n, F.lit('</p><p class="oj-sti-art">Links`</p>'),
        F.regexp_extract("html", "(?s)<article>(.*?)</article>", 1), F.lit("<table>"), F.array_join(F.transform(links, row), ""), F.lit('</table>after<div>inner</div>tail<p class="oj-note">no</p></div></div>'),
    ).alias("html"))


@query
def page_units(s, d):
    """Units of marked-up pages: fixtures (ids below 0) and all of `pages`."""
    pages = fixture(s, "marked_pages").select((-F.col("page_id")).cast("long").alias("page_id"), "html").unionByName(_marked_up(table(s, d, "pages")))
    return parsing.page_units(pages, base.BASE_URL).select("page_id", "unit_id", "kind", "citation", "title", "chapter", "chapter_title", "url", "body")


@query
def heading_ffill(s, d):
    return parsing.forward_fill_headings(fixture(s, "blocks", d)).select("doc", "pos", "chapter", "chapter_title", "section", "section_title")


@query
def route_kind(s, d):
    return fixture(s, "kinds", d).withColumn("kind", parsing.kind_of(F.col("classes"), F.col("element_id"))).where("kind is not null")


@query
def unit_projection(s, d):
    u = parsing.unit_projection(fixture(s, "units", d), base.BASE_URL)
    return u.withColumn("number", F.try_element_at("meta", F.col("kind"))).drop("meta")


# chunking


@query
def approx_tokens(s, d):
    return table(s, d, "documents").select("doc_id", T.approx_tokens(_doc()).alias("n_tokens"))


@query
def enumerated_atoms(s, d):
    both = fixture(s, "atoms").select((-F.col("id")).cast("long").alias("id"), "body").unionByName(table(s, d, "documents").select(F.col("doc_id").alias("id"), _doc().alias("body")))
    return both.select("id", F.posexplode(chunking.atoms(F.col("body"))).alias("pos", "atom"))


@query
def sentence_split(s, d):
    lit = fixture(s, "sentences").select((-F.col("id")).cast("long").alias("id"), F.posexplode(T.split_sentences(F.col("body"))).alias("pos", "sentence"))
    return lit.unionByName(table(s, d, "documents").select(F.col("doc_id").alias("id"), F.posexplode(T.split_sentences(_doc())).alias("pos", "sentence")))


@query
def pack_sentences(s, d):
    parts = chunking.pack(T.split_sentences(_doc()), DEFAULT.max_chunk_tokens, " ")
    return table(s, d, "documents").select("doc_id", F.posexplode(parts).alias("pos", "part"))


@query
def chunk_documents(s, d):
    return chunking.chunk_units(base.units(s, d)).select("chunk_id", "unit_id", "part", "n_parts", "body", "text", "n_tokens")


@query
def breadcrumb(s, d):
    return fixture(s, "crumbs", d).select("id", chunking.breadcrumb(*[F.col(c) for c in ("chapter", "section", "citation", "part", "n_parts")]).alias("crumb"))


@query
def corpus_stats(s, d):
    return chunking.corpus_stats(chunking.chunk_units(base.units(s, d)))


# indexing


@query
def tokenize(s, d):
    t = T.tokenize(_doc())
    return table(s, d, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.md5(F.array_join(t, " ")).alias("digest"))


@query
def l2_normalize(s, d):
    e = table(s, d, "embeddings").select("vec_id", F.posexplode(indexing.l2_normalize(F.transform("embedding", lambda x: x * F.lit(3.0)))).alias("pos", "x"))
    return e.select("vec_id", "pos", F.round("x", 6).alias("x"))


@query
def index_projection(s, d):
    return indexing.index_projection(chunking.chunk_units(base.units(s, d)))


@query
def index_no_recitals(s, d):
    return indexing.without_kind(base.corpus(s, d), "recital").select("chunk_id", "kind")


@query
def bm25_index_stats(s, d):
    return indexing.term_statistics(indexing.document_lengths(base.corpus(s, d))).select("term", "df", F.round("idf", 6).alias("idf"))


# retrieval


@query
def bm25_topk(s, d):
    return retrieval.search(base.asked(s, d), base.corpus(s, d), 10, "bm25")


@query
def bm25_topk_padded(s, d):
    """All questions, their last words (ids from -1 down) and one without a match: rankings filled up with chunks of score 0."""
    q = base.asked(s, d)
    last = q.select((-1 - F.col("query_id")).alias("query_id"), F.try_element_at(T.tokenize(F.col("question")), F.lit(-1)).alias("question"))
    none = s.range(1).select(F.lit(-1_000_000).cast("long").alias("query_id"), F.lit("zzzzqq").alias("question"))
    return retrieval.bm25(q.unionByName(last).unionByName(none), base.corpus(s, d), 10, padded=True)


@query
def bm25_topk_blocks(s, d):
    """The rows of bm25_topk by a stored index of blocks with their highest weights, built here."""
    path = f"{shared_dir(s)}/posting-index-{uuid.uuid4().hex}"
    postings.build(base.corpus(s, d), path)
    return postings.search(base.asked(s, d), path, 10)


@query
def bm25_topk_segments(s, d):
    """Search over an index that was filled in two parts and lost every tenth document."""
    path, c = f"{shared_dir(s)}/segments-{uuid.uuid4().hex}", base.corpus(s, d).select("chunk_id", "text")
    for i in range(2):
        segments.add(c.where(F.pmod("chunk_id", F.lit(2)) == i), path)
    segments.delete(c.where("chunk_id % 10 = 3").select("chunk_id"), path)
    return segments.search(base.asked(s, d), path, 10)


@query
def hit_projection(s, d):
    """The nine columns of a hit; documents have no title line and no chapter."""
    chunks = base.corpus(s, d).select("chunk_id", "kind", "text", F.concat(F.lit("doc_"), F.col("chunk_id").cast("string")).alias("unit_id"), F.concat(F.lit("Document "), F.col("chunk_id").cast("string")).alias("citation"), F.concat(F.lit(base.BASE_URL + "#doc_"), F.col("chunk_id").cast("string")).alias("url"))
    return indexing.hit_columns(retrieval.search(base.asked(s, d), base.corpus(s, d), 10, "bm25"), chunks).withColumn("text", F.md5("text"))


def _vectors(s, d):
    return table(s, d, "embeddings")


@query
def dense_topk(s, d):
    v = _vectors(s, d)
    return retrieval.dense(v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), v.select(F.col("vec_id").alias("chunk_id"), "embedding"), 10)


@query
def dense_topk_lsh(s, d):
    """The queries of dense_topk."""
    v = _vectors(s, d)
    return retrieval.dense_lsh(v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), v.select(F.col("vec_id").alias("chunk_id"), "embedding"), 10)


@query
def dense_topk_index(s, d):
    """The queries of dense_topk by a stored index of quantised lists, built here."""
    v = _vectors(s, d)
    path = f"{shared_dir(s)}/vector-index-{uuid.uuid4().hex}"
    vector_index.build(v.select(F.col("vec_id").alias("chunk_id"), "embedding"), path)
    return vector_index.search(v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), path, 10)


@query
def dense_topk_trained(s, d):
    """Questions and documents by an encoder that is learnt from the documents."""
    c = base.corpus(s, d)
    return retrieval.search(base.asked(s, d), c, 10, "dense", encode=encoder.encoder(encoder.train(c)))


def _fused(s, d, weights):
    return retrieval.fused(base.runs(s, d), base.corpus(s, d).select("chunk_id", "kind"), K, weights)


@query
def rrf_hybrid(s, d):
    return _fused(s, d, [1.0]).drop("weight")


@query
def rrf_weighted(s, d):
    return _fused(s, d, [DEFAULT.kind_weight]).drop("weight")


@query
def rrf_drop_kind(s, d):
    return _fused(s, d, [0.0]).drop("weight")


# grounding


def _hits_with_text(s, d):
    return base.bm25_hits(s, d, K).join(base.corpus(s, d).select("chunk_id", "kind", "text"), "chunk_id").withColumn("citation", F.concat(F.lit("Document "), F.col("chunk_id").cast("string")))


@query
def format_context(s, d):
    return grounding.format_context(_hits_with_text(s, d))


@query
def build_prompt(s, d):
    c = grounding.format_context(_hits_with_text(s, d)).join(base.asked(s, d), "query_id")
    return c.select("query_id", F.md5(grounding.build_prompt(F.col("context"), F.col("question"))).alias("prompt_md5"))


@query
def parse_citations(s, d):
    return fixture(s, "answers", d).select("id", F.array_join(T.parse_citations(F.col("answer")), ",").alias("units"))


@query
def abstained(s, d):
    return base.answers(s, d).select("query_id", grounding.abstained(F.col("answer")).alias("abstained"))


@query
def retrieved_units(s, d):
    halves = base.bm25_hits(s, d).withColumn("unit_id", F.floor(F.col("chunk_id") / 20).cast("long"))
    return grounding.retrieved_units(halves).select("query_id", F.array_join(F.col("retrieved_units").cast("array<string>"), ",").alias("units"))


@query
def answer_join(s, d):
    return grounding.answer_join(base.asked(s, d), base.answers(s, d).select("query_id", "answer", "model")).select("query_id", "answer", "model", "abstained", F.array_join("cited_units", ",").alias("cited"))


@query
def fabricated_citations(s, d):
    return base.eval_rows(s, d).select("query_id", F.array_join(grounding.fabricated(F.col("cited_units"), F.col("retrieved_units")), ",").alias("fabricated"))


@query
def passage_preview(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(grounding.passage_preview(_doc())).alias("preview_md5"))


@query
def config_drift(s, d):
    return grounding.config_drift(fixture(s, "running", d), fixture(s, "measured", d))


# rate limits


@query
def estimate_tokens(s, d):
    return ratelimit.estimate_tokens(table(s, d, "conversations"), "conv_id", DEFAULT.reply_tokens)


@query
def rolling_token_budget(s, d):
    return ratelimit.rolling_budget(base.ledger(s, d), 3600, 120.0).select("event_id", "spent", "would_block")


@query
def learnt_token_budget(s, d):
    """The budget by limits that were read from answers."""
    calls = base.ledger(s, d)
    learnt = calls.groupBy("model").agg(F.max("tokens").alias("limit")).where(F.col("model") % 2 == 0)
    return ratelimit.rolling_budget(calls, 3600, 120.0, limits=learnt).select("event_id", "spent", "would_block")


def _seen_limits(s, d):
    """Limits as answers of every seventh event told them."""
    return base.ledger(s, d).where("event_id % 7 = 0").select("model", "ts", (F.col("event_id") % 200 + 100).alias("limit"))


@query
def asof_limit(s, d):
    return ratelimit.asof_limits(base.ledger(s, d), _seen_limits(s, d), stretch=86_400).select("event_id", "limit")


@query
def asof_token_budget(s, d):
    """The budget by the limit that was last seen before each call."""
    calls = ratelimit.asof_limits(base.ledger(s, d), _seen_limits(s, d), stretch=86_400)
    return ratelimit.rolling_budget(calls, 86_400, 120.0, limit_col="limit").select("event_id", "spent", "would_block")


@query
def admission_times(s, d):
    """When each call goes if it waits for room in a window of a day."""
    calls = admission.admitted(base.ledger(s, d), id_col="event_id", seconds=86_400, limit=200.0, nap=1 << 50)
    return calls.select("event_id", F.unix_micros("admitted").alias("admitted"))


@query
def retry_schedule(s, d):
    f = fixture(s, "statuses", d).withColumn("retry_after", F.when(F.col("id") == 3, 7.0))
    return ratelimit.retry_schedule(f).select("id", "attempt", "wait")


@query
def available_providers(s, d):
    """Whether each user's provider can be asked, with a key of one of them at hand."""
    there = [(p, ratelimit.available(p, {"GROQ_API_KEY": "x"})) for p in ("groq", "openai", "gemini", "ollama", "nobody")]
    return _users(s, d).join(F.broadcast(s.createDataFrame(there, "provider string, there boolean")), "provider").select("user_id", "provider", "there")


@query
def cited_hits(s, d):
    hits = base.bm25_hits(s, d, K).withColumn("unit_id", F.concat(F.lit("art_"), F.col("chunk_id").cast("string")))
    told = base.asked(s, d).select("query_id", F.array(F.concat(F.lit("art_"), F.col("query_id").cast("string"))).alias("cited_units")).where("query_id % 5 > 0")
    return grounding.cited_hits(hits, told).select("query_id", "rank", "cited")


@query
def parse_duration(s, d):
    return fixture(s, "durations", d).select("id", F.round(T.duration_seconds(F.col("s")), 6).alias("seconds"))


@query
def latest_limit(s, d):
    return ratelimit.latest_limit(base.ledger(s, d).select("model", F.struct("ts", "event_id").alias("ts"), F.when(F.col("event_id") % 3 > 0, F.col("event_id")).alias("limit")))


@query
def classify_status(s, d):
    kind, minutes = ratelimit.classify_status(F.col("status"), F.col("body"))
    return fixture(s, "statuses", d).select("id", kind.alias("class"), F.round(minutes, 4).alias("minutes"))


# metrics


@query
def topk_units(s, d):
    hits = base.bm25_hits(s, d).withColumn("unit_id", F.floor(F.col("chunk_id") / 20).cast("long"))
    return metrics.topk_units(hits, ["query_id"], K)


def _scores(s, d, ks=(K,)):
    return metrics.metrics_at(base.bm25_hits(s, d), base.questions(s, d).select("query_id", "gold_units"), list(ks))


def _metric(name):
    def f(s, d):
        return _scores(s, d).select("query_id", F.round(name, 9).alias(name))

    f.__name__ = f"metric_{name}"
    return query(f)


for _m in metrics.METRICS:
    _metric(_m)


@query
def retrieval_metrics(s, d):
    sc = metrics.metrics_at(base.all_modes(s, d), base.questions(s, d).select("query_id", "gold_units"), [K], ("mode",))
    return sc.select("mode", "k", "query_id", *[F.round(m, 9).alias(m) for m in metrics.METRICS])


@query
def citation_validity(s, d):
    return base.eval_rows(s, d).select("query_id", F.round("citation_validity", 9).alias("citation_validity"))


# evaluation


@query
def answerable(s, d):
    return evaluation.answerable(base.questions(s, d)).select("query_id", "type")


@query
def metrics_at_k(s, d):
    return _scores(s, d, KS).select("k", "query_id", *[F.round(m, 9).alias(m) for m in metrics.METRICS])


def _means(s, d):
    sc = metrics.metrics_at(base.all_modes(s, d), base.questions(s, d).select("query_id", "gold_units"), KS, ("mode",))
    return metrics.mean_metrics(sc, ["mode", "k"])


@query
def mean_metrics(s, d):
    return _means(s, d)


@query
def metrics_by_type(s, d):
    q = base.questions(s, d)
    sc = metrics.metrics_at(base.all_modes(s, d), q.select("query_id", "gold_units"), [K], ("mode",))
    return metrics.metrics_by_type(sc, q, ["mode", "k"])


def _ablation(s, d):
    f = _fused(s, d, WEIGHTS).withColumn("unit_id", F.col("chunk_id"))
    return metrics.mean_metrics(metrics.metrics_at(f, base.questions(s, d).select("query_id", "gold_units"), [K], ("weight",)), ["weight"])


@query
def ablation_weights(s, d):
    return _ablation(s, d)


@query
def failure_taxonomy(s, d):
    return base.eval_rows(s, d).select("query_id", "type", "grade", "failure")


@query
def grade_rows(s, d):
    return base.eval_rows(s, d).select("query_id", "grade", F.round("faithfulness", 9).alias("faithfulness"), "n_claims")


@query
def models_from(s, d):
    return evaluation.models_from(base.eval_rows(s, d))


@query
def resume_pending(s, d):
    return evaluation.pending(base.questions(s, d), base.answers(s, d)).select("query_id", "type")


@query
def reorder_rows(s, d):
    rows = base.answers(s, d).select(F.when(F.col("query_id") % 9 == 0, F.col("query_id") + 100_000).otherwise(F.col("query_id")).alias("query_id"))
    return evaluation.in_question_order(rows, base.listed(s, d))


@query
def eval_summary(s, d):
    return evaluation.eval_summary(base.eval_rows(s, d))


@query
def summary_by_type(s, d):
    return evaluation.summary_by_type(base.eval_rows(s, d))


@query
def failure_modes(s, d):
    return evaluation.failure_modes(base.eval_rows(s, d))


@query
def coverage(s, d):
    return evaluation.coverage(base.listed(s, d), base.answers(s, d))


@query
def coverage_banner(s, d):
    return report.banner(evaluation.coverage(base.listed(s, d), base.answers(s, d)))


@query
def ragas_input(s, d):
    rows = base.eval_rows(s, d).withColumn("contexts", F.when(F.col("query_id") % 2 == 0, F.col("retrieved_units")).otherwise(F.array().cast("array<string>")))
    return evaluation.external_judge_input(rows, base.questions(s, d)).withColumn("contexts", F.array_join("contexts", "|"))


@query
def limit_queries(s, d):
    return evaluation.first_questions(base.asked(s, d).withColumn("ord", F.col("query_id")), 10).select("query_id", "question")


# judging


@query
def model_family(s, d):
    return fixture(s, "models", d).select("model", T.model_family(F.col("model")).alias("family"))


@query
def pick_judge(s, d):
    return judging.pick_judge(fixture(s, "models", d), fixture(s, "preferences"), "default/judge")


@query
def extract_json(s, d):
    return fixture(s, "judge_texts", d).select("id", T.json_text(F.col("s")).alias("json"))


@query
def number_claims(s, d):
    return fixture(s, "claims", d).select("id", judging.number_claims(F.col("claims"), DEFAULT.max_claims).alias("numbered"))


@query
def faithfulness(s, d):
    return fixture(s, "verdicts", d).select("id", F.round(judging.faithfulness(judging.verdicts(F.col("s"))), 9).alias("score"))


@query
def unsupported_claims(s, d):
    u = F.explode(judging.unsupported(judging.verdicts(F.col("s"))))
    return fixture(s, "verdicts", d).select("id", u.alias("v")).select("id", F.col("v.claim_index").alias("claim_index"))


@query
def validate_grade(s, d):
    return fixture(s, "grades", d).select("id", judging.validated_grade(F.col("grade")).alias("grade"))


# reports


@query
def fmt_metrics(s, d):
    return fixture(s, "figures", d).select("id", T.percent(F.col("p")).alias("p"), T.decimal3(F.col("d")).alias("d"))


@query
def report_strategies(s, d):
    return report.formatted(_means(s, d).where(F.col("k") == K), ["mode"])


@query
def report_by_type(s, d):
    q = base.questions(s, d)
    sc = metrics.metrics_at(base.all_modes(s, d), q.select("query_id", "gold_units"), [K], ("mode",))
    return report.formatted(metrics.metrics_by_type(sc, q, ["mode"]).where("type <> 'overall'"), ["mode", "type"], ("hit_rate", "recall", "full_recall"), ("mrr",))


@query
def report_k_pivot(s, d):
    return report.k_pivot(_means(s, d), KS)


@query
def report_ablation(s, d):
    return report.ablation(_ablation(s, d), DEFAULT.kind_weight)


@query
def report_failures(s, d):
    return report.failures(base.eval_rows(s, d))


@query
def report_failing(s, d):
    return report.failing(base.eval_rows(s, d))


@query
def report_unsupported(s, d):
    return report.unsupported(base.eval_rows(s, d))
