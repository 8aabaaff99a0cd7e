"""Result hydration, evidence, answers and reranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.functions import fixed_values as V
from quarrylight.functions import text as T
from quarrylight.operators import details as DT
from quarrylight.operators import evidence as EV
from quarrylight.operators import rerank as RR
from quarrylight.operators import retrieve as R
from quarrylight.plans import sqltext as S
from quarrylight.plans.catalog_views import iso
from quarrylight.plans.oracle_views import VIEWS, view
from quarrylight.plans.registry import query
from quarrylight.plans.search_views import program_search_sql
from quarrylight.sources.corpus import Corpus


@query("snippets", f"""
SELECT doc_id, {S.snippet('text', 'probe')} AS snippet FROM (
  SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN coalesce(regexp_extract(text, '(\\S+)\\s*$', 1), '') WHEN 1 THEN 'a of zz' ELSE 'qqqq xyzzy' END AS probe
  FROM documents)""")
def snippets(c: Corpus):
    """Every document with its last word, only short words, or unknown words as query."""
    d = F.col("doc_id")
    probe = F.when(d % 3 == 0, F.regexp_extract("text", r"(\S+)\s*$", 1)).when(d % 3 == 1, "a of zz").otherwise("qqqq xyzzy")
    rows = c.raw("documents").select("doc_id", "text", probe.alias("probe"))
    return T.with_snippet(rows, "text", "probe").select("doc_id", "snippet")


_program_fields = [
    ("program", "p.name"), ("summary", "p.summary"), ("experience level", "p.experience_level"),
    ("days per week", "p.days_per_week"), ("specialization", "p.specialization"), ("progression", "p.progression_type"),
    ("split", "p.split_type"), ("coach", "p.coach_name"), ("source title", "s.title"), ("source url", "s.canonical_url"),
    ("source content", S.bounded("d.raw_text", V.PROGRAM_TEXT_LIMIT)),
]
view("v_program_text", f"""
SELECT p.id AS program_id, {S.lines(_program_fields)} AS text
FROM v_programs p JOIN v_documents d ON d.id = p.document_id JOIN v_sources s ON s.id = d.source_id""")
_evidence_fields = [
    ("source title", "s.title"), ("source type", "s.source_type"), ("author", "s.author"), ("source url", "s.canonical_url"),
    ("source content", S.bounded("d.raw_text", V.EVIDENCE_TEXT_LIMIT)),
]
view("v_evidence_text", f"""
SELECT s.id AS source_id, {S.lines(_evidence_fields)} AS text
FROM v_sources s LEFT JOIN v_documents d ON d.id = s.latest_document_id""")


def program_texts(c: Corpus, wanted=None):
    """(program_id, text) of every program, or of those in wanted(program_id): then only their documents' texts are read on."""
    docs = c.document_texts.withColumnRenamed("id", "document_id")
    programs = c.programs
    if wanted is not None:
        programs = programs.join(wanted.select(F.col("program_id").alias("id")).distinct(), "id", "left_semi")
        docs = docs.join(programs.select("document_id").distinct(), "document_id", "left_semi")
    src = c.sources.select(F.col("id").alias("source_id"), F.col("title").alias("source_title"), "canonical_url")
    rows = programs.join(c.document_keys.select(F.col("id").alias("document_id"), "source_id"), "document_id").join(src, "source_id").join(docs, "document_id")
    return rows.select(F.col("id").alias("program_id"), T.program_text({k: F.col(k) for k in rows.columns}).alias("text"))


def evidence_texts(c: Corpus, wanted=None):
    """(source_id, text) of every source, or of those in wanted(source_id)."""
    sources = c.sources
    if wanted is not None:
        sources = sources.join(wanted.select(F.col("source_id").alias("id")).distinct(), "id", "left_semi")
    docs = c.document_texts.withColumnRenamed("id", "latest_document_id")
    if wanted is not None:
        docs = docs.join(sources.select("latest_document_id").distinct(), "latest_document_id", "left_semi")
    rows = sources.withColumnRenamed("title", "source_title").join(docs, "latest_document_id", "left")
    return rows.select(F.col("id").alias("source_id"), T.evidence_text({k: F.col(k) for k in rows.columns}).alias("text"))


@query("program_text", "SELECT * FROM v_program_text")
def program_text(c: Corpus):
    return program_texts(c)


@query("evidence_text", "SELECT * FROM v_evidence_text")
def evidence_text(c: Corpus):
    return evidence_texts(c)


@query("program_results", f"""
SELECT r.query_id, r.rank, r.leg, r.program_id, r.doc_id, r.source_id, r.confidence, p.name, p.coach_name, p.days_per_week, p.specialization,
  p.experience_level, p.progression_type, p.split_type, p.summary, s.canonical_url, s.title AS source_title, d.domain AS source_domain
FROM {program_search_sql(25)} r JOIN v_programs p ON p.id = r.program_id JOIN v_sources s ON s.id = r.source_id
LEFT JOIN v_domains d ON d.id = s.domain_id""")
def program_results(c: Corpus):
    return DT.program_results(R.search_programs(c.requests, c, 25), c).drop("text_rank")


@query("source_results", f"""
SELECT r.query_id, r.rank, r.source_id, s.canonical_url, s.status, {S.iso('s.last_crawled_at')} AS last_crawled_at, s.title, d.domain,
  {S.snippet('x.raw_text', 'q.query')} AS excerpt, {S.iso('x.published_at')} AS published_at, x.parse_confidence AS confidence
FROM v_source_ranks r JOIN v_requests q USING (query_id) JOIN v_sources s ON s.id = r.source_id LEFT JOIN v_domains d ON d.id = s.domain_id
LEFT JOIN v_documents x ON x.id = s.latest_document_id WHERE r.rank <= 25""")
def source_results(c: Corpus):
    rows = DT.source_results(c.stage(R.search_sources(c.requests, c, 25), "seen"), c.requests, c)
    return rows.withColumn("last_crawled_at", iso("last_crawled_at")).withColumn("published_at", iso("published_at"))


@query("source_list", f"""
SELECT s.id, canonical_url, status, {S.iso('last_crawled_at')} AS last_crawled_at, d.domain, title
FROM v_sources s JOIN v_domains d ON d.id = s.domain_id WHERE status = 'succeeded' ORDER BY s.id LIMIT 100""")
def source_list(c: Corpus):
    return DT.source_list(c, 100, status="succeeded").withColumn("last_crawled_at", iso("last_crawled_at"))


view("v_latest_crawl", """
SELECT source_id, id, status, retry_count, cost, started_at, completed_at FROM v_crawl_jobs WHERE source_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC NULLS FIRST, id DESC) = 1""")


@query("latest_crawl", f"SELECT * REPLACE ({S.iso('started_at')} AS started_at, {S.iso('completed_at')} AS completed_at) FROM v_latest_crawl")
def latest_crawl(c: Corpus):
    rows = DT.latest_crawl(c.crawl_jobs)
    return rows.withColumn("started_at", iso("started_at")).withColumn("completed_at", iso("completed_at"))


@query("source_detail", f"""
SELECT s.id AS source_id, m.domain, s.canonical_url, s.source_type, s.title, s.author, s.status, {S.iso('s.last_crawled_at')} AS last_crawled_at,
  d.id AS document_id, coalesce(j.id, l.id) AS crawl_id, CASE WHEN j.id IS NULL THEN l.status ELSE j.status END AS crawl_status,
  CASE WHEN j.id IS NULL THEN l.retry_count ELSE j.retry_count END AS retry_count,
  {S.iso('CASE WHEN j.id IS NULL THEN l.started_at ELSE j.started_at END')} AS started_at,
  {S.iso('CASE WHEN j.id IS NULL THEN l.completed_at ELSE j.completed_at END')} AS completed_at, coalesce(p.programs, '') AS programs
FROM v_sources s JOIN v_domains m ON m.id = s.domain_id LEFT JOIN v_documents d ON d.id = s.latest_document_id
LEFT JOIN v_crawl_jobs j ON j.id = d.crawl_job_id LEFT JOIN v_latest_crawl l ON l.source_id = s.id
LEFT JOIN (SELECT document_id, string_agg(id || ':' || coalesce(name, ''), '|' ORDER BY id) AS programs FROM v_programs GROUP BY 1) p ON p.document_id = d.id""")
def source_detail(c: Corpus):
    named = F.transform("programs", lambda p: F.concat(p["id"].cast("string"), F.lit(":"), F.coalesce(p["name"], F.lit(""))))
    return DT.source_detail(c).select(
        "source_id", "domain", "canonical_url", "source_type", "title", "author", "status", iso("last_crawled_at").alias("last_crawled_at"),
        "document_id", F.col("crawl.id").alias("crawl_id"), F.col("crawl.status").alias("crawl_status"),
        F.col("crawl.retry_count").alias("retry_count"), iso("crawl.started_at").alias("started_at"),
        iso("crawl.completed_at").alias("completed_at"), F.coalesce(F.array_join(named, "|"), F.lit("")).alias("programs"),
    )


@query("crawl_list", f"""
SELECT id, job_type, source_id, target_url, status, retry_count, {S.iso('started_at')} AS started_at, {S.iso('completed_at')} AS completed_at
FROM v_crawl_jobs ORDER BY v_crawl_jobs.started_at DESC NULLS FIRST, id DESC LIMIT 50""")
def crawl_list(c: Corpus):
    rows = DT.crawl_list(c.crawl_jobs, 50)
    return rows.select("id", "job_type", "source_id", "target_url", "status", "retry_count",
                       iso("started_at").alias("started_at"), iso("completed_at").alias("completed_at"))


# -- evidence ----------------------------------------------------------------
view("v_ranked_programs", f"""
SELECT p.*, r.max_sources FROM {program_search_sql(EV.MAX_PROGRAMS)} p JOIN v_requests r USING (query_id) WHERE p.rank <= r.max_programs""")
view("v_ranked_sources", f"""
SELECT s.* FROM v_source_ranks s JOIN v_requests r USING (query_id) WHERE s.rank <= least(r.max_sources, {EV.MAX_SOURCES})""")
view("v_program_evidence", """
SELECT query_id, source_id, doc_id AS document_id, rank, program_id, confidence FROM v_ranked_programs WHERE rank <= greatest(1, max_sources // 2)
QUALIFY row_number() OVER (PARTITION BY query_id, source_id, doc_id ORDER BY rank) = 1""")
view("v_evidence", """
SELECT * FROM (SELECT e.*, row_number() OVER (PARTITION BY query_id ORDER BY part, part_rank) AS rank, r.max_sources, r.query
  FROM (SELECT query_id, source_id, document_id, 'program_match' AS reason, program_id, confidence, 0 AS part, rank AS part_rank FROM v_program_evidence
    UNION ALL
    SELECT k.query_id, k.source_id, coalesce(s.latest_document_id, 0), 'source_fallback', NULL, NULL, 1, k.rank
    FROM v_ranked_sources k JOIN v_sources s ON s.id = k.source_id
    WHERE NOT EXISTS (SELECT 1 FROM v_program_evidence p WHERE p.query_id = k.query_id AND p.source_id = k.source_id AND p.document_id = coalesce(s.latest_document_id, 0))) e
  JOIN v_requests r USING (query_id)) WHERE rank <= max_sources""")
view("v_cards", f"""
SELECT e.query_id, e.rank, e.source_id, e.document_id, e.reason, s.canonical_url, CASE WHEN e.part = 0 THEN p.name ELSE s.title END AS title,
  {S.snippet('d.raw_text', 'e.query')} AS snippet, CASE WHEN e.part = 0 THEN e.confidence ELSE d.parse_confidence END AS parse_confidence,
  s.last_crawled_at, m.domain AS plain_domain, CASE WHEN e.part = 0 THEN {S.netloc('s.canonical_url')} ELSE m.domain END AS domain,
  s.title AS source_title, d.published_at
FROM v_evidence e JOIN v_sources s ON s.id = e.source_id JOIN v_domains m ON m.id = s.domain_id
LEFT JOIN v_programs p ON p.id = e.program_id LEFT JOIN v_documents d ON d.id = e.document_id""")


def cards(c: Corpus, lists=None):
    return c.stage(EV.evidence_cards(c.requests, c, lists), "cards")


@query("request_validation", rf"""
SELECT query_id, reject_reason IS NULL AS accepted, reject_reason, query, domain FROM (
  SELECT query_id, q AS query, dom AS domain, CASE WHEN query = '' OR q = '' THEN 'query_must_not_be_blank' WHEN length(query) > 400 THEN 'query_too_long'
    WHEN NOT max_sources BETWEEN 1 AND 50 THEN 'max_sources_out_of_range' WHEN NOT max_programs BETWEEN 1 AND 100 THEN 'max_programs_out_of_range'
    WHEN NOT max_evidence BETWEEN 1 AND 25 THEN 'max_evidence_out_of_range'
    WHEN dom IS NOT NULL AND NOT (length(dom) <= 253 AND regexp_matches(dom, '^(?:[a-z0-9](?:[a-z0-9-]{{0,61}}[a-z0-9])?\.)+[a-z]{{2,63}}$')) THEN 'invalid_domain_filter' END AS reject_reason
  FROM (SELECT query_id, query, {S.strip('query')} AS q, nullif(lower({S.strip('domain')}), '') AS dom, max_sources, max_programs, max_evidence FROM (
    SELECT conv_id * 1000 + turn AS query_id, text AS query, CASE turn % 5 WHEN 0 THEN ' Example.COM ' WHEN 1 THEN 'bad_domain' WHEN 2 THEN ' ' ELSE NULL END AS domain,
      CASE WHEN conv_id % 10 = 3 THEN 51 ELSE 8 END AS max_sources, CASE WHEN conv_id % 10 = 4 THEN 0 ELSE 20 END AS max_programs,
      CASE WHEN conv_id % 10 = 5 THEN 26 ELSE 8 END AS max_evidence FROM conversations
    UNION ALL SELECT 1000000000 + query_id, query, domain, max_sources, max_programs, max_evidence FROM v_asked)))""")
def request_validation(c: Corpus):
    """Conversation turns (often too long) and the regular requests."""
    t, v = F.col("turn"), F.col("conv_id")
    turns = c.raw("conversations").select(
        (v * 1000 + t).alias("query_id"), F.col("text").alias("query"),
        F.when(t % 5 == 0, " Example.COM ").when(t % 5 == 1, "bad_domain").when(t % 5 == 2, " ").alias("domain"),
        F.when(v % 10 == 3, 51).otherwise(8).alias("max_sources"), F.when(v % 10 == 4, 0).otherwise(20).alias("max_programs"),
        F.when(v % 10 == 5, 26).otherwise(8).alias("max_evidence"),
    )
    own = c.asked.select((1_000_000_000 + F.col("query_id")).alias("query_id"), *turns.columns[1:])
    return EV.validate_requests(turns.unionByName(own)).select("query_id", "accepted", "reject_reason", "query", "domain")


@query("evidence_programs", "SELECT * FROM v_program_evidence")
def evidence_programs(c: Corpus):
    return EV.program_evidence(EV.ranked_lists(c.requests, c)[0])


@query("evidence_cards", f"""
SELECT * EXCLUDE (plain_domain) REPLACE ({S.iso('last_crawled_at')} AS last_crawled_at, {S.iso('published_at')} AS published_at) FROM v_cards""")
def evidence_cards(c: Corpus):
    return cards(c).withColumn("last_crawled_at", iso("last_crawled_at")).withColumn("published_at", iso("published_at"))


@query("retrieval_status", f"""
SELECT query_id, CASE WHEN n > 0 THEN 'ok' ELSE 'insufficient_evidence' END AS status, CASE WHEN n = 0 THEN 0.0::DOUBLE END AS confidence,
  n AS evidence_selected, CASE WHEN n = 0 THEN '{V.INSUFFICIENT_TEXT}' ELSE 'Retrieved ' || n || ' evidence items for query ''' || query
    || '''. Use evidence cards for grounded synthesis.' END AS answer
FROM (SELECT r.query_id, r.query, count(e.rank) AS n FROM v_requests r LEFT JOIN v_evidence e USING (query_id) GROUP BY 1, 2)""")
def retrieval_status(c: Corpus):
    return EV.retrieval_status(c.requests, cards(c))


def _ids(view_name: str, column: str) -> str:
    return f"SELECT query_id, string_agg(CAST({column} AS VARCHAR), ',' ORDER BY rank) AS ids, count(*) AS n FROM {view_name} GROUP BY 1"


@query("retrieval_debug", f"""
SELECT r.query_id, r.query, coalesce(s.ids, '') AS source_candidates, coalesce(p.ids, '') AS program_candidates, coalesce(e.ids, '') AS evidence,
  coalesce(s.n, 0) AS n_source_candidates, coalesce(p.n, 0) AS n_program_candidates, coalesce(e.n, 0) AS n_evidence, 'baseline' AS retrieval_mode
FROM v_requests r LEFT JOIN ({_ids('v_ranked_sources', 'source_id')}) s USING (query_id)
LEFT JOIN ({_ids('v_ranked_programs', 'program_id')}) p USING (query_id) LEFT JOIN ({_ids('v_evidence', 'source_id')}) e USING (query_id)""")
def retrieval_debug(c: Corpus):
    lists = EV.ranked_lists(c.requests, c)
    return EV.retrieval_debug(c.requests, *lists, cards(c, lists))


view("v_answers", f"""
SELECT r.query_id, CASE WHEN u.n IS NULL THEN 'insufficient_evidence' ELSE 'ok' END AS status,
  CASE WHEN u.n IS NULL THEN 0.0::DOUBLE ELSE u.confidence END AS confidence, coalesce(u.n, 0) AS n_evidence,
  CASE WHEN u.n IS NULL THEN '{V.INSUFFICIENT_TEXT}' ELSE concat_ws(' ',
    'For ''' || r.query || ''', here are the strongest grounded takeaways from the indexed coaching corpus.', 'Found ' || u.n || ' grounded evidence items.',
    'Most relevant programs and sources: ' || array_to_string(nullif(u.titles[1:5], []), ', ') || '.',
    'Key practical cues from source text: - ' || array_to_string(nullif(u.snippets[1:3], []), ' - '),
    'Strongest supporting domains: ' || d.top_domains || '.',
    CASE WHEN u.confidence < 0.65 THEN 'Evidence quality is limited, so treat these findings as directional rather than conclusive.'
      WHEN u.n < 2 THEN 'Only one supporting source was found, so this answer carries meaningful uncertainty.' END,
    'Use evidence cards below for transparent source-level verification.') END AS answer
FROM v_requests r
LEFT JOIN (SELECT c.query_id, count(*) AS n, coalesce(list(title ORDER BY rank) FILTER (WHERE title <> ''), []) AS titles,
    coalesce(list(snippet ORDER BY rank) FILTER (WHERE snippet <> ''), []) AS snippets, round(avg(parse_confidence), 10) AS confidence
  FROM v_cards c JOIN v_requests q USING (query_id) WHERE c.rank <= q.max_evidence GROUP BY 1) u USING (query_id)
LEFT JOIN (SELECT query_id, string_agg(dom, ', ' ORDER BY n DESC, first_rank) AS top_domains FROM (
    SELECT c.query_id, {S.netloc('c.canonical_url')} AS dom, count(*) AS n, min(c.rank) AS first_rank
    FROM v_cards c JOIN v_requests q USING (query_id) WHERE c.rank <= q.max_evidence GROUP BY 1, 2
    QUALIFY row_number() OVER (PARTITION BY c.query_id ORDER BY count(*) DESC, min(c.rank)) <= 3) GROUP BY 1) d USING (query_id)""")


@query("answers", "SELECT * FROM v_answers")
def answers(c: Corpus):
    return EV.answers(c.requests, cards(c))


@query("answer_summary", "SELECT status, count(*) AS requests, sum(n_evidence) AS evidence FROM v_answers GROUP BY status".replace("sum(n_evidence)", "CAST(sum(n_evidence) AS BIGINT)"))
def answer_summary(c: Corpus):
    a = EV.answers(c.requests, cards(c))
    return a.groupBy("status").agg(F.count("*").alias("requests"), F.sum("n_evidence").alias("evidence"))


@query("evidence_display", f"""
SELECT query_id, rank, canonical_url, domain, coalesce(nullif(source_title, ''), nullif(title, ''), 'Supporting source') AS title, snippet,
  CASE WHEN parse_confidence IS NULL THEN 'Quality not rated' WHEN parse_confidence >= 0.85 THEN 'High source quality'
    WHEN parse_confidence >= 0.65 THEN 'Moderate source quality' ELSE 'Limited source quality' END AS quality,
  {S.iso('coalesce(published_at, last_crawled_at)')} AS reviewed_at
FROM v_cards QUALIFY row_number() OVER (PARTITION BY query_id, canonical_url ORDER BY rank) = 1""")
def evidence_display(c: Corpus):
    return EV.displayed(cards(c)).withColumn("reviewed_at", iso("reviewed_at"))


# -- reranking ---------------------------------------------------------------
view("v_scored", f"""
SELECT x.*, round(CASE WHEN nt = 0 THEN 0 ELSE hits / nt::DOUBLE END + 0.4::DOUBLE * text_rank + 0.1::DOUBLE * coalesce(confidence, 0), 6) AS score
FROM (SELECT p.query_id, p.rank, p.program_id, p.doc_id, p.source_id, p.text_rank, p.confidence, r.max_sources, r.max_programs, len(list_distinct({S.tokens('r.query')})) AS nt,
    len(list_intersect(list_distinct({S.tokens('r.query')}), {S.tokens('t.text')})) AS hits
  FROM {program_search_sql(50)} p JOIN v_requests r USING (query_id) JOIN v_program_text t USING (program_id)
  WHERE {S.strip('r.query')} <> '') x""")

view("v_scored_sources", f"""
SELECT x.*, round(CASE WHEN nt = 0 THEN 0 ELSE hits / nt::DOUBLE END + 0.4::DOUBLE * text_rank, 6) AS score
FROM (SELECT p.query_id, p.rank, p.source_id, p.text_rank, r.max_sources, len(list_distinct({S.tokens('r.query')})) AS nt,
    len(list_intersect(list_distinct({S.tokens('r.query')}), {S.tokens('t.text')})) AS hits
  FROM v_source_ranks p JOIN v_requests r USING (query_id) JOIN v_evidence_text t USING (source_id)
  WHERE p.rank <= 50 AND {S.strip('r.query')} <> '') x""")


def source_candidates(c: Corpus, limit: int = 25):
    """Source candidates to the depth, ``limit`` at least, with the query and the words of their latest document."""
    asked = c.requests.where(T.strip(F.col("query")) != "")
    found = c.stage(R.search_sources(asked, c, max(limit, V.RERANK_DEPTH)), "source-candidates")
    words = evidence_texts(c, found).select("source_id", F.array_distinct(T.tokens(F.col("text"))).alias("words"))
    rows = found.join(asked.select("query_id", "query"), "query_id").join(words, "source_id")
    return rows.withColumn("confidence", F.lit(None).cast("double"))


def rerank_candidates(c: Corpus, limit: int = 25):
    """Program candidates to the depth, ``limit`` at least, with the query and the words of their text.

    Words are taken once per program, however many requests it is a candidate
    of, and only of programs that are one.
    """
    asked = c.requests.where(T.strip(F.col("query")) != "")
    found = R.search_programs(asked, c, max(limit, V.RERANK_DEPTH))
    found = c.stage(found, "candidates")
    rows = found.join(asked.select("query_id", "query"), "query_id")
    words = program_texts(c, found).select("program_id", F.array_distinct(T.tokens(F.col("text"))).alias("words"))
    return rows.join(words, "program_id")


@query("rerank", """
SELECT query_id, program_id, rank AS base_rank, score, new_rank AS rank, 'reranked' AS mode
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS new_rank FROM v_scored) WHERE new_rank <= 25""")
def rerank(c: Corpus):
    out = RR.rerank(rerank_candidates(c), RR.coverage_scorer, 25)
    return out.select("query_id", "program_id", F.col("base_rank"), "score", "rank", "mode")


@query("rerank_sources", """
SELECT query_id, source_id, rank AS base_rank, score, new_rank AS rank, 'reranked' AS mode
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS new_rank FROM v_scored_sources) WHERE new_rank <= 25""")
def rerank_sources(c: Corpus):
    out = RR.rerank(source_candidates(c), RR.coverage_scorer, 25)
    return out.select("query_id", "source_id", "base_rank", "score", "rank", "mode")


# Evidence that is selected from the new order of both lists.
view("v_reranked_programs", """
SELECT * REPLACE (new_rank AS rank) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS new_rank FROM v_scored) WHERE new_rank <= max_programs""")
view("v_reranked_sources", """
SELECT * REPLACE (new_rank AS rank) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS new_rank FROM v_scored_sources) WHERE new_rank <= max_sources""")
view("v_program_evidence_r", VIEWS["v_program_evidence"].replace("v_ranked_programs", "v_reranked_programs"))
view("v_evidence_r", VIEWS["v_evidence"].replace("v_program_evidence", "v_program_evidence_r").replace("v_ranked_sources", "v_reranked_sources"))


@query("evidence_reranked", "SELECT query_id, rank, source_id, document_id, reason, program_id FROM v_evidence_r")
def evidence_reranked(c: Corpus):
    """Evidence of requests with text, selected after both lists were reranked to depth."""
    limits = c.requests.select("query_id", "max_sources", "max_programs")
    most = limits.agg(F.max("max_sources").alias("sources"), F.max("max_programs").alias("programs")).first()
    programs = RR.rerank(rerank_candidates(c, most["programs"]), RR.coverage_scorer, most["programs"])
    sources = RR.rerank(source_candidates(c, most["sources"]), RR.coverage_scorer, most["sources"])
    programs = programs.join(limits, "query_id").where("rank <= max_programs")
    sources = sources.join(limits, "query_id").where("rank <= max_sources")
    kept = EV.cut_evidence(EV.select_evidence(programs, sources, c), limits)
    return kept.select("query_id", "rank", "source_id", "document_id", "reason", "program_id")


def flaky_scorer(item: str = "program_id", remainder: int = 1):
    """The coverage scorer, failing on some items of some requests."""
    def score(candidates):
        scored = RR.coverage_scorer(candidates)
        bad = (F.col("query_id") % 7 == 2) & (F.col(item) % 5 == remainder)
        return scored.withColumn("failure", F.when(bad, "inference_error")).withColumn("score", F.when(~bad, F.col("score")))

    return score


@query("rerank_fail_open", """
WITH s AS (SELECT *, query_id % 7 = 2 AND program_id % 5 = 1 AS bad FROM v_scored),
t AS (SELECT *, bool_or(bad) OVER (PARTITION BY query_id) AS failed FROM s),
u AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN failed THEN 0 ELSE score END DESC, rank) AS new_rank FROM t)
SELECT query_id, program_id, new_rank AS rank, CASE WHEN failed THEN 'baseline_fallback' ELSE 'reranked' END AS mode,
  CASE WHEN failed THEN 'inference_error' END AS fallback_reason FROM u WHERE new_rank <= 25""")
def rerank_fail_open(c: Corpus):
    out = RR.rerank(rerank_candidates(c), flaky_scorer(), 25)
    return out.select("query_id", "program_id", "rank", "mode", "fallback_reason")


@query("retrieval_modes", """
WITH p AS (SELECT query_id, CASE WHEN bool_or(query_id % 7 = 2 AND program_id % 5 = 1) THEN 'baseline_fallback' ELSE 'reranked' END AS mode FROM v_scored GROUP BY 1),
s AS (SELECT query_id, CASE WHEN bool_or(query_id % 7 = 2 AND source_id % 5 = 2) THEN 'baseline_fallback' ELSE 'reranked' END AS mode FROM v_scored_sources GROUP BY 1),
b AS (SELECT * FROM p UNION ALL SELECT * FROM s)
SELECT query_id, CASE WHEN min(mode) = max(mode) THEN min(mode) ELSE 'mixed_fallback' END AS retrieval_mode,
  CASE WHEN bool_or(mode = 'baseline_fallback') THEN 'inference_error' END AS fallback_reason FROM b GROUP BY 1""")
def retrieval_modes(c: Corpus):
    """Mode of both lists together, each scored by a scorer that fails on some of its items."""
    keep = ("query_id", "mode", "fallback_reason")
    programs = RR.rerank(rerank_candidates(c), flaky_scorer(), 25).select(*keep)
    sources = RR.rerank(source_candidates(c), flaky_scorer("source_id", 2), 25).select(*keep)
    return RR.combined_mode(sources, programs)
