"""Logs, artifacts, suites, datasets, streams and the learned reranker."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarrylight.functions import fixed_values as V
from quarrylight.operators import evaluate as E
from quarrylight.operators import evidence as EV
from quarrylight.operators import labels as L
from quarrylight.operators import learn as LR
from quarrylight.operators import normalize as N
from quarrylight.operators import retrieve as R
from quarrylight.operators import runs as RU
from quarrylight.operators import shards as SH
from quarrylight.plans import catalog_learning as CL
from quarrylight.plans import sqltext as S
from quarrylight.plans.catalog_answers import evidence_texts, program_texts
from quarrylight.plans.catalog_views import iso
from quarrylight.plans.oracle_views import clone_views, view
from quarrylight.plans.registry import query
from quarrylight.plans.search_views import program_search_sql
from quarrylight.sources import artifacts as AR
from quarrylight.sources import ledger as LE
from quarrylight.sources import suites as SU
from quarrylight.sources.corpus import Corpus, day, plus_seconds
from quarrylight.streaming import feeds as FE
from quarrylight.streaming import limits as LI


def fresh_path(c: Corpus, label: str) -> str:
    return f"{c.home}/stage/{label}-{uuid.uuid4().hex[:12]}"


# -- ledgers and traces --------------------------------------------------------
@query("ledger_recent", f"""
SELECT 'run-' || k AS run_id, {S.iso('at_time')} AS completed_at, n AS processed
FROM (SELECT event_id // 100 AS k, max(ts) AS at_time, count(*) AS n FROM events GROUP BY 1)
ORDER BY {S.iso('at_time')} DESC, 'run-' || k DESC LIMIT 20""")
def ledger_recent(c: Corpus):
    """A ledger with blank, broken and foreign lines, read back."""
    per = c.raw("events").groupBy(F.floor(F.col("event_id") / 100).alias("k")).agg(
        F.max(F.col("ts").cast("timestamp")).alias("at"), F.count("*").alias("n")
    )
    good = F.concat(
        F.lit('{"run_id":"run-'), "k", F.lit('","completed_at":"'), iso("at"), F.lit('","totals":{"processed":'), "n", F.lit("}}")
    )
    k = F.col("k") % 5
    other = F.when(k == 1, "").when(k == 2, "{broken").when(k == 3, "[1, 2]")
    path = fresh_path(c, "ledger")
    per.select(F.explode(F.array_compact(F.array(good, other))).alias("value")).write.text(path)
    rows = LE.read_recent(c.spark, path, 20)
    return rows.select("run_id", "completed_at", F.try_variant_get("record", "$.totals.processed", "bigint").alias("processed"))


@query("ledger_roundtrip", "SELECT run_id, processed, failure_rate, top_error_codes, should_fail FROM v_run_summary")
def ledger_roundtrip(c: Corpus):
    """Run records appended in two writes and read back."""
    runs = RU.run_summary(c.run_items).withColumn("completed_at", iso("completed_at")).withColumn("started_at", iso("started_at"))
    path = fresh_path(c, "ledger")
    runs = c.stage(runs, "runs")
    for part in (0, 1):
        LE.append_lines(runs.where(F.col("run_id") % 2 == part), path)
    back = LE.parse_lines(c.spark.read.text(path))

    def get(name: str, kind: str):
        return F.try_variant_get("record", f"$.{name}", kind).alias(name)

    return back.select(
        get("run_id", "bigint"), get("processed", "bigint"), get("failure_rate", "double"), get("top_error_codes", "string"),
        get("should_fail", "boolean"),
    )


@query("ledger_stream", "SELECT CAST(run_id AS VARCHAR) AS run_id, count(*) AS items FROM v_run_items GROUP BY 1")
def ledger_stream(c: Corpus):
    """Run items appended to a log by a stream, then counted per run."""
    items = c.run_items.select("run_id", "item_id", "item_type", "status")
    source = fresh_path(c, "items")
    items.write.parquet(source)
    stream = c.spark.readStream.schema(items.schema).parquet(source)
    sink = fresh_path(c, "log")
    FE.run_to_end(LE.as_lines(stream), fresh_path(c, "checkpoint"), sink=sink, fmt="text")
    records = LE.parse_lines(c.spark.read.text(sink))
    return records.groupBy(F.try_variant_get("record", "$.run_id", "string").alias("run_id")).agg(F.count("*").alias("items"))


@query("trace_sink", """
SELECT r.query_id, strftime(TIMESTAMP '2024-02-01 12:00:00' + to_days(CAST(r.query_id % 3 AS INTEGER)), '%Y-%m-%d') AS day, count(e.rank) AS n_evidence
FROM v_requests r LEFT JOIN v_evidence e USING (query_id) GROUP BY 1""")
def trace_sink(c: Corpus):
    lists = EV.ranked_lists(c.requests, c)
    cards = c.stage(EV.evidence_cards(c.requests, c, lists), "cards")
    at = plus_seconds(day("2024-02-01 12:00:00"), (F.col("query_id") % 3) * 86400)
    traces = EV.retrieval_debug(c.requests, *lists, cards).withColumn("recorded_at", at)
    path = fresh_path(c, "traces")
    LE.write_traces(traces, path)
    back = c.spark.read.schema("query_id long, n_evidence long, day date").json(path)
    return back.select("query_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "n_evidence")


# -- artifacts -----------------------------------------------------------------
@query("artifact_index", f"""
WITH a AS (SELECT source_id, document_id AS crawl_id, 'json' AS kind, output AS body FROM v_payloads WHERE output IS NOT NULL
UNION ALL SELECT source_id, document_id, 'html', coalesce({', '.join(
    f"CASE WHEN json_type(j, '$.{k}') = 'VARCHAR' AND trim(json_extract_string(j, '$.{k}')) <> '' THEN json_extract_string(j, '$.{k}') END" for k in V.HTML_KEYS)},
  '<html><body><pre>' || replace(replace(replace(replace(replace(coalesce(raw_text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')
  || '</pre></body></html>') FROM v_fields)
SELECT source_id, crawl_id, kind, 'sources/' || source_id || '/crawls/' || crawl_id || '/' || (CASE kind WHEN 'html' THEN 'raw.html' ELSE 'extracted.json' END) AS path,
  length(body) AS size, md5(body) AS digest FROM a""")
def artifact_index(c: Corpus):
    crawl = F.col("document_id").alias("crawl_id")
    json_ = c.payloads.where("output IS NOT NULL").select("source_id", crawl, F.lit("json").alias("kind"), F.col("output").alias("body"))
    html = N.raw_html(N.fields(N.coerce(c.payloads))).select("source_id", crawl, F.lit("html").alias("kind"), F.col("html").alias("body"))
    path = fresh_path(c, "artifacts")
    AR.write_artifacts(json_.unionByName(html), path)
    return AR.index_artifacts(c.spark.read.parquet(path))


# -- suites --------------------------------------------------------------------
view("v_suite_rows", """
SELECT r.query_id, 0 AS at_no, 't-' || r.query_id AS name, 'sources' AS mode, CASE WHEN r.query_id % 4 = 1 THEN '' ELSE r.query END AS query,
  CASE r.query_id % 4 WHEN 0 THEN 10 WHEN 1 THEN 30 WHEN 2 THEN 1 ELSE 10 END AS top_k, CASE WHEN r.query_id % 4 = 1 THEN u.domain END AS domain,
  NULL::BIGINT AS days_per_week, [u.canonical_url] AS expected FROM v_requests r JOIN v_page_urls u ON u.page_id = r.query_id % 50
UNION ALL SELECT r.query_id, 2, 'unnamed', 'programs', r.query, 5, NULL, CASE WHEN r.query_id % 3 = 1 THEN 4 END,
  CASE WHEN r.query_id % 3 = 0 THEN [] ELSE [u.canonical_url] END FROM v_requests r JOIN v_page_urls u ON u.page_id = r.query_id % 50
UNION ALL SELECT query_id, 3, 'unnamed', '', '', 10, NULL, NULL, [] FROM v_requests""")


def suite_files(c: Corpus):
    """One suite document per request: a source test, a program test, junk."""
    q = F.col("query_id")
    pages = c.page_urls.select(F.col("page_id").alias("home"), "canonical_url", F.col("domain").alias("home_domain"))
    rows = c.requests.select("query_id", "query", (q % 50).alias("home")).join(pages, "home")
    # The text as a JSON string, quotes and line ends escaped.
    quoted = F.regexp_extract(F.to_json(F.struct("query")), r'(?s)^\{"query":(.*)\}$', 1)
    sources = F.concat(
        F.lit('{"name":"t-'), q, F.lit('","mode":" Sources ","query":'), F.when(q % 4 == 1, '""').otherwise(quoted), F.lit(","),
        F.when(q % 4 == 0, '"top_k":0,').when(q % 4 == 1, F.concat(F.lit('"top_k":30,"filters":{"domain":"'), "home_domain", F.lit('"},')))
        .when(q % 4 == 2, '"top_k":-2,"filters":"none",').otherwise(""),
        F.lit('"must_include_canonical_urls":["'), "canonical_url", F.lit('",5]}'),
    )
    programs = F.concat(
        F.lit('{"name":"","mode":"PROGRAMS","query":'), quoted, F.lit(',"top_k":5,'),
        F.when(q % 3 == 1, '"filters":{"days_per_week":4,"unknown":1},').otherwise(""),
        F.when(q % 3 == 0, '"must_include_canonical_urls":[]').otherwise(F.concat(F.lit('"must_include_canonical_urls":["'), "canonical_url", F.lit('"]'))),
        F.lit("}"),
    )
    body = F.concat(F.lit('{"queries":['), sources, F.lit(',"junk",'), programs, F.lit(",{}]}"))
    return rows.select("query_id", body.alias("body"))


@query("eval_suite_load", """
SELECT query_id, at_no AS at, name, mode, query, top_k, domain, days_per_week, array_to_string(expected, ' ') AS expected FROM v_suite_rows""".replace("AS at,", 'AS "at",'))
def eval_suite_load(c: Corpus):
    return SU.load_suite(suite_files(c), "query_id").withColumn("expected", F.array_join("expected", " "))


view("v_suite_requests", """
SELECT query_id * 10 + at_no AS query_id, query, mode, top_k, expected, domain, days_per_week, NULL::VARCHAR AS specialization, NULL::VARCHAR AS experience_level,
  NULL::VARCHAR AS progression_type, NULL::VARCHAR AS split_type FROM v_suite_rows""")
clone_views("v_requests", "v_suite_requests", "_s", ["v_exact_programs", "v_expanded_programs", "v_source_ranks"])


_SEARCH_EVAL = f"""
WITH o AS (SELECT p.query_id, p.rank, s.canonical_url FROM {program_search_sql(30).replace('v_exact_programs', 'v_exact_programs_s').replace('v_expanded_programs', 'v_expanded_programs_s')} p
    JOIN v_suite_requests t USING (query_id) JOIN v_sources s ON s.id = p.source_id WHERE t.mode = 'programs' AND p.rank <= t.top_k
  UNION ALL SELECT r.query_id, r.rank, s.canonical_url FROM v_source_ranks_s r JOIN v_suite_requests t USING (query_id) JOIN v_sources s ON s.id = r.source_id
    WHERE t.mode = 'sources' AND r.rank <= t.top_k),
x AS (SELECT t.query_id AS test_id, t.mode, t.expected, list_filter(t.expected, lambda u: NOT list_contains(coalesce(l.urls, []), u)) AS missing, coalesce(l.urls, []) AS observed
  FROM v_suite_requests t LEFT JOIN (SELECT query_id, list(canonical_url ORDER BY rank) AS urls FROM o GROUP BY 1) l USING (query_id))
SELECT test_id, mode, len(observed) AS n_observed, array_to_string(observed, ' ') AS observed, array_to_string(missing, ' ') AS missing,
  len(missing) = 0 AND mode IN ('programs', 'sources') AS passed FROM x"""


@query("search_eval", _SEARCH_EVAL)
def search_eval(c: Corpus):
    return evaluate_suite(c).select(
        "test_id", "mode", F.size("observed").cast("long").alias("n_observed"), F.array_join("observed", " ").alias("observed"),
        F.array_join("missing", " ").alias("missing"), "passed",
    )


def evaluate_suite(c: Corpus):
    suite = SU.load_suite(suite_files(c), "query_id").withColumn("test_id", F.col("query_id") * 10 + F.col("at"))
    suite = c.stage(suite, "suite")
    text = F.lit(None).cast("string")
    tests = suite.select(
        F.col("test_id").alias("query_id"), "query", "mode", "top_k", "domain", "days_per_week",
        *[text.alias(f) for f in R.FILTERS if f not in ("domain", "days_per_week")],
    )
    deepest = tests.agg(F.max("top_k")).first()[0] or 1  # one number
    s = R.shelf(c)
    cut = tests.select("query_id", "mode", "top_k")
    progs = R.search_programs(tests.where("mode = 'programs'"), c, deepest)
    progs = progs.join(s.programs.select("program_id", "canonical_url"), "program_id")
    srcs = R.search_sources(tests.where("mode = 'sources'"), c, deepest)
    srcs = srcs.join(s.sources.select("source_id", "canonical_url"), "source_id")
    keep = ("query_id", "rank", "canonical_url")
    seen = progs.select(*keep).unionByName(srcs.select(*keep)).join(cut, "query_id").where("rank <= top_k")
    return E.check_must_include(suite, seen.withColumnRenamed("query_id", "test_id"))


@query("search_eval_totals", f"""
SELECT count(*) AS queries_total, count(*) FILTER (WHERE mode IN ('programs', 'sources')) AS valid_modes, count(*) FILTER (WHERE passed) AS queries_passed,
  round(coalesce(count(*) FILTER (WHERE passed) / nullif(count(*), 0)::DOUBLE, 0), 10) AS pass_rate FROM ({_SEARCH_EVAL})""")
def search_eval_totals(c: Corpus):
    return E.suite_totals(evaluate_suite(c))


@query("human_judgments_load", """
SELECT query_id, program_id, min(relevance) AS relevance, CASE WHEN bool_or(relevance NOT IN (0, 1, 2, 3)) THEN 'grade_out_of_range' WHEN count(*) > 1 THEN 'duplicate' END AS problem
FROM (SELECT 'q' || (document_id % 40) AS query_id, document_id AS program_id, CASE WHEN document_id % 16 = 3 THEN 7 ELSE relevance END AS relevance FROM v_grades
  UNION ALL SELECT 'q' || (document_id % 40), document_id, 1 FROM v_grades WHERE document_id % 9 = 0) GROUP BY 1, 2""")
def human_judgments_load(c: Corpus):
    d = F.col("document_id")
    pair = F.concat(F.lit('{"query_id":"q'), d % 40, F.lit('","program_id":'), d, F.lit(',"relevance":'))
    first = F.concat(pair, F.when(d % 16 == 3, 7).otherwise(F.col("relevance")).cast("string"), F.lit("}"))
    again = F.when(d % 9 == 0, F.concat(F.lit(","), pair, F.lit("1}"))).otherwise("")
    return SU.load_judgments(c.grades.select(F.concat(F.lit('{"scale":"0-3","judgments":['), first, again, F.lit("]}")).alias("body")))


@query("dataset_roundtrip", """
SELECT q.query_id, q.candidate_collection, l.candidate_no, l.program_id, l.source_id, p.canonical_url, p.candidate_source, l.baseline_rank, l.relevance, l.reason
FROM v_labels l JOIN v_queries q USING (query_id) JOIN v_pools p ON p.query_id = l.query_id AND p.candidate_no = l.candidate_no""")
def dataset_roundtrip(c: Corpus):
    """The labelled dataset written as nested JSON and loaded again."""
    own = CL.pools(c).select("query_id", "candidate_no", "canonical_url", "candidate_source")
    rows = CL.labels(c).join(own, ["query_id", "candidate_no"])
    path = fresh_path(c, "dataset")
    SU.save_dataset(CL.dataset_queries(c).withColumn("status", F.lit("frozen")), rows, path)
    back = SU.load_dataset(c.spark.read.schema(SU.DATASET_SCHEMA).json(path)).where("program_id IS NOT NULL OR source_id IS NOT NULL")
    return back.select(
        F.col("query_id").cast("long").alias("query_id"), "candidate_collection", "candidate_no", "program_id", "source_id", "canonical_url",
        "candidate_source", "baseline_rank", "relevance", "reason",
    )


@query("review_export", """
SELECT 'program:' || x.program_id AS candidate_key, p.name AS title, x.text FROM (SELECT DISTINCT program_id FROM v_pools WHERE program_id IS NOT NULL) k
JOIN v_program_text x USING (program_id) JOIN v_programs p ON p.id = x.program_id
UNION ALL SELECT 'source:' || x.source_id, s.title, x.text FROM (SELECT DISTINCT source_id FROM v_pools WHERE source_id IS NOT NULL) k
JOIN v_evidence_text x USING (source_id) JOIN v_sources s ON s.id = x.source_id""")
def review_export(c: Corpus):
    used = CL.pools(c)
    a = program_texts(c).join(used.select("program_id"), "program_id", "left_semi").join(c.programs.select(F.col("id").alias("program_id"), F.col("name").alias("title")), "program_id")
    b = evidence_texts(c).join(used.select("source_id"), "source_id", "left_semi").join(c.sources.select(F.col("id").alias("source_id"), "title"), "source_id")
    return a.select(F.concat(F.lit("program:"), "program_id").alias("candidate_key"), "title", "text").unionByName(
        b.select(F.concat(F.lit("source:"), "source_id").alias("candidate_key"), "title", "text")
    )


# -- limits and streams ----------------------------------------------------------
WINDOW, MOST = 86_400, 2
view("v_api", "SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(ts) / 1000000.0::DOUBLE AS at_s, event_id AS request_id FROM events")
_LIMIT_SQL = f"""
WITH g AS (SELECT key, list_reduce(list([at_s] ORDER BY at_s, request_id), lambda acc, x:
    CASE WHEN len(list_filter(acc, lambda t: t >= x[1] - {WINDOW})) < {MOST} THEN list_concat(acc, x) ELSE acc END) AS ok FROM v_api GROUP BY key),
r AS (SELECT a.*, list_contains(g.ok, a.at_s) AS accepted, list_min(list_filter(g.ok, lambda t: t >= a.at_s - {WINDOW} AND t < a.at_s)) AS oldest FROM v_api a JOIN g USING (key))
SELECT key, request_id, accepted, CASE WHEN NOT accepted THEN CAST(floor(greatest(1.0, {WINDOW} - (at_s - oldest))) AS BIGINT) END AS retry_after FROM r"""


def api_requests(c: Corpus):
    rows = c.raw("events")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    return rows.select(F.col("user_id").cast("string").alias("key"), at.alias("at"), F.col("event_id").alias("request_id"))


@query("rate_limit", _LIMIT_SQL)
def rate_limit(c: Corpus):
    return LI.rate_limit(api_requests(c), WINDOW, MOST).select("key", "request_id", "accepted", "retry_after")


@query("rate_limit_stream", _LIMIT_SQL)
def rate_limit_stream(c: Corpus):
    """Requests in two micro-batches by time, the second after a restart."""
    sink = fresh_path(c, "decisions")
    _in_two_runs(c, api_requests(c), F.col("at"), lambda stream: LI.rate_limit_stream(stream, WINDOW, MOST), sink=sink)
    return c.spark.read.schema(LI.DECISION).parquet(sink).select("key", "request_id", "accepted", "retry_after")


def _in_two_runs(c: Corpus, rows, order, build, **end):
    """Feed ``rows`` to a stream in two parts, cut in the middle of ``order``; the second run starts again from the checkpoint."""
    source, checkpoint = fresh_path(c, "feed"), fresh_path(c, "checkpoint")
    rows = c.stage(rows, "rows")
    cut = rows.agg(F.avg(order.cast("double"))).first()[0]
    for part in (F.coalesce(order.cast("double") <= cut, F.lit(True)), order.cast("double") > cut):
        rows.where(part).write.mode("append").parquet(source)
        FE.run_to_end(build(c.spark.readStream.schema(rows.schema).parquet(source)), checkpoint, **end)


def _limited(source: str, key: str, most: int) -> str:
    """SQL for (request_id, accepted, retry_after) of the requests of ``source``, limited by ``key``."""
    return f"""(WITH g AS (SELECT {key} AS k, list_reduce(list([at_s] ORDER BY at_s, request_id), lambda acc, x:
    CASE WHEN len(list_filter(acc, lambda t: t >= x[1] - {WINDOW})) < {most} THEN list_concat(acc, x) ELSE acc END) AS ok FROM {source} GROUP BY 1),
r AS (SELECT a.*, list_contains(g.ok, a.at_s) AS accepted, list_min(list_filter(g.ok, lambda t: t >= a.at_s - {WINDOW} AND t < a.at_s)) AS oldest FROM {source} a JOIN g ON g.k = a.{key})
SELECT request_id, accepted, CASE WHEN NOT accepted THEN CAST(floor(greatest(1.0, {WINDOW} - (at_s - oldest))) AS BIGINT) END AS retry_after FROM r)"""


IP_MOST = 5
view("v_api_two", "SELECT request_id, at_s, CAST(CAST(key AS BIGINT) % 40 AS VARCHAR) AS ip, key AS usr FROM v_api")
view("v_api_ip", f"SELECT * FROM {_limited('v_api_two', 'ip', IP_MOST)}")
view("v_api_passed", "SELECT t.* FROM v_api_two t JOIN v_api_ip i USING (request_id) WHERE i.accepted")


@query("rate_limit_two_keys", f"""
SELECT t.request_id, t.ip, t.usr AS user, i.accepted AND coalesce(u.accepted, false) AS accepted,
  CASE WHEN NOT i.accepted THEN 'ip' WHEN NOT u.accepted THEN 'user' END AS limited_by, coalesce(i.retry_after, u.retry_after) AS retry_after
FROM v_api_two t JOIN v_api_ip i USING (request_id) LEFT JOIN {_limited('v_api_passed', 'usr', MOST)} u USING (request_id)""".replace("AS user,", 'AS "user",'))
def rate_limit_two_keys(c: Corpus):
    rows = api_requests(c)
    rows = rows.select("request_id", "at", (F.col("key").cast("long") % 40).cast("string").alias("ip"), F.col("key").alias("user"))
    return LI.two_key_limit(rows, WINDOW, IP_MOST, MOST)


@query("quota_usage", f"""
SELECT key, {V.ASK_LIFETIME_LIMIT} AS "limit", least(count(*), {V.ASK_LIFETIME_LIMIT}) AS used, {V.ASK_LIFETIME_LIMIT} - least(count(*), {V.ASK_LIFETIME_LIMIT}) AS remaining,
  count(*) < {V.ASK_LIFETIME_LIMIT} AS can_ask, count(*) - least(count(*), {V.ASK_LIFETIME_LIMIT}) AS rejected FROM v_api GROUP BY key""")
def quota_usage(c: Corpus):
    return LI.quota_usage(api_requests(c), V.ASK_LIFETIME_LIMIT)


@query("quota_accepted", f"""
SELECT key, request_id, used FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY at_s, request_id) AS used FROM v_api) WHERE used <= {V.ASK_LIFETIME_LIMIT}""")
def quota_accepted(c: Corpus):
    return LI.quota_accepted(api_requests(c), V.ASK_LIFETIME_LIMIT).select("key", "request_id", "used")


@query("quota_stream", f"""
SELECT key, request_id, used <= {V.ASK_LIFETIME_LIMIT} AS accepted, least(used, {V.ASK_LIFETIME_LIMIT}) AS used, {V.ASK_LIFETIME_LIMIT} - least(used, {V.ASK_LIFETIME_LIMIT}) AS remaining
FROM (SELECT key, request_id, row_number() OVER (PARTITION BY key ORDER BY at_s, request_id) AS used FROM v_api)""")
def quota_stream(c: Corpus):
    """Lifetime quotas counted by a stream in two micro-batches by time, the second after a restart."""
    sink = fresh_path(c, "quota")
    _in_two_runs(c, api_requests(c), F.col("at"), lambda stream: LI.quota_stream(stream, V.ASK_LIFETIME_LIMIT), sink=sink)
    return c.spark.read.schema("key string, request_id long, accepted boolean, used long, remaining long").parquet(sink)


@query("stream_discovery", f"""
SELECT DISTINCT s.canonical_url FROM v_safe s WHERE s.canonical_url IS NOT NULL AND {S.allowed_url('s.canonical_url')}
  AND s.canonical_url NOT IN (SELECT canonical_url FROM v_sources WHERE status <> 'pending')""")
def stream_discovery(c: Corpus):
    source, sink = fresh_path(c, "candidates"), fresh_path(c, "new_sources")
    rows = c.candidates.select("raw_url", plus_seconds(day("2024-01-01"), F.col("page_id")).alias("seen_at"))
    rows.write.parquet(source)
    stream = c.spark.readStream.schema(rows.schema).parquet(source)
    # Pending sources have not been seen yet: the feed may find them.
    known = c.sources.where("status <> 'pending'").select("canonical_url")
    FE.run_to_end(FE.discovered(stream), fresh_path(c, "checkpoint"), step=FE.append_new(lambda: known, sink))
    return c.spark.read.schema("canonical_url string").parquet(sink).select("canonical_url")


_HEALTH_SQL = """
SELECT strftime(date_trunc('day', started_at), '%Y-%m-%d') AS day, count(*) AS jobs, count(*) FILTER (WHERE status IN ('succeeded', 'failed')) AS attempted,
  count(*) FILTER (WHERE status = 'failed') AS failed,
  round(count(*) FILTER (WHERE status = 'failed') / nullif(count(*) FILTER (WHERE status IN ('succeeded', 'failed')), 0)::DOUBLE, 6) AS failure_rate
FROM v_crawl_jobs WHERE started_at IS NOT NULL GROUP BY 1"""


def _by_day(rows):
    return rows.withColumn("day", F.date_format("window_start", "yyyy-MM-dd")).drop("window_start")


@query("crawl_health_windows", _HEALTH_SQL)
def crawl_health_windows(c: Corpus):
    return _by_day(FE.crawl_health(c.crawl_jobs))


# The stream sees jobs of ids that 5 divides after all others: those whose day had closed by then are late.
view("v_late_jobs", """
SELECT *, id % 5 = 0 AND date_trunc('day', started_at) + INTERVAL 1 DAY <= (SELECT max(started_at) FROM v_crawl_jobs WHERE id % 5 <> 0) - INTERVAL 1 DAY AS late
FROM v_crawl_jobs WHERE started_at IS NOT NULL""")


def _health(c: Corpus) -> FE.HealthSink:
    """The health of all jobs as a stream in two runs, the jobs of every fifth id last."""
    jobs, source, checkpoint = c.crawl_jobs.select("id", "started_at", "status"), fresh_path(c, "jobs"), fresh_path(c, "checkpoint")
    sink = FE.HealthSink(fresh_path(c, "health"))
    for part in ("id % 5 <> 0", "id % 5 = 0"):
        jobs.where(part).write.mode("append").parquet(source)
        FE.run_to_end(c.spark.readStream.schema(jobs.schema).parquet(source), checkpoint, step=sink.step)
    return sink


@query("crawl_health_stream", _HEALTH_SQL.replace("FROM v_crawl_jobs WHERE started_at IS NOT NULL", "FROM v_late_jobs WHERE NOT late"))
def crawl_health_stream(c: Corpus):
    """Windows kept by a stream: closed ones are final, late rows stay out of them."""
    return _by_day(_health(c).windows(c.spark))


@query("crawl_health_late", "SELECT id, strftime(date_trunc('day', started_at), '%Y-%m-%d') AS day, status FROM v_late_jobs WHERE late")
def crawl_health_late(c: Corpus):
    """The rows whose window had closed before they came."""
    rows = _health(c).late(c.spark, "id long, started_at timestamp, status string")
    return rows.select("id", F.date_format("started_at", "yyyy-MM-dd").alias("day"), "status")


# -- learned reranking -----------------------------------------------------------
_N = len(LR.FEATURES) + 1
_columns = ["1.0::DOUBLE", *LR.FEATURES]
_sums = ", ".join(
    "[" + ", ".join(
        [f"coalesce(sum(weight * {a} * {b}), 0)" + (f" + {LR.RIDGE}::DOUBLE * sum(weight)" if i == j and i else "") for j, b in enumerate(_columns)]
        + [f"coalesce(sum(weight * {a} * target), 0)"]
    ) + "]" for i, a in enumerate(_columns)
)
view("v_features", f"""
SELECT l.query_id, s.split, l.candidate_no, l.baseline_rank, l.relevance, l.relevance / 3.0::DOUBLE AS target,
  CASE WHEN l.reason = '{V.HUMAN_REASON}' THEN {LR.HUMAN_WEIGHT}::DOUBLE ELSE 1.0::DOUBLE END AS weight,
  coalesce(f.text_rank, g.text_rank, 0.0::DOUBLE) AS text_rank, b.score AS text_overlap,
  coalesce((CASE WHEN p.p_days_per_week = i.intent_days THEN 3 ELSE 0 END) + (CASE WHEN p.p_experience_level = i.intent_experience THEN 3 ELSE 0 END)
    + (CASE WHEN p.p_split_type = i.intent_split THEN 2 ELSE 0 END), 0)::DOUBLE AS intent,
  coalesce(p.page_quality, o.page_quality, 0)::DOUBLE AS page_quality, coalesce(p.confidence, 0)::DOUBLE AS confidence,
  CASE WHEN f.leg = 'exact' OR g.source_id IS NOT NULL THEN 1.0::DOUBLE WHEN f.leg = 'expanded' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS leg
FROM v_labels l JOIN v_train_splits s USING (query_id) JOIN v_bootstrap b ON b.query_id = l.query_id AND b.candidate_no = l.candidate_no
JOIN v_intent i ON i.query_id = l.query_id LEFT JOIN v_found f ON f.query_id = l.query_id AND f.program_id = l.program_id
LEFT JOIN v_seen g ON g.query_id = l.query_id AND g.source_id = l.source_id
LEFT JOIN v_shelf_programs p ON p.program_id = l.program_id LEFT JOIN v_shelf_sources o ON o.source_id = l.source_id""")
view("v_weights_solved", f"""
WITH RECURSIVE g AS (
  SELECT 0 AS k, [{_sums}] AS m FROM v_features WHERE split = 'train'
  UNION ALL SELECT k + 1, list_transform(range({_N}), lambda i: CASE WHEN i = k THEN list_transform(m[k + 1], lambda x: x / m[k + 1][k + 1])
    ELSE list_transform(range({_N + 1}), lambda j: m[i + 1][j + 1] - m[i + 1][k + 1] * m[k + 1][j + 1] / m[k + 1][k + 1]) END) FROM g WHERE k < {_N})
SELECT list_transform(m, lambda r: r[{_N + 1}]) AS w FROM g WHERE k = {_N}""")
view("v_learned", f"""
SELECT query_id, split, candidate_no, baseline_rank, relevance, round(w[1] + {" + ".join(f"w[{i + 2}] * {f}" for i, f in enumerate(LR.FEATURES))}, 6) AS score
FROM v_features, v_weights_solved""")
for _name, _order in (("base", "baseline_rank NULLS LAST, candidate_no"), ("model", "score DESC, candidate_no")):
    view(f"v_learned_{_name}", f"SELECT query_id, split, relevance, row_number() OVER (PARTITION BY query_id ORDER BY {_order}) AS rank FROM v_learned")
    view(f"v_means_{_name}", f"""
SELECT split, round(avg(ndcg), 6) AS ndcg, round(avg(rr), 6) AS mrr FROM ({CL._ndcg(f'v_learned_{_name}', 10)}) n
JOIN (SELECT query_id, min(split) AS split, round(coalesce(1.0::DOUBLE / min(rank) FILTER (WHERE relevance > 0), 0), 6) AS rr FROM v_learned_{_name} GROUP BY 1) USING (query_id) GROUP BY split""")


@query("learned_rerank_eval", """
SELECT q.split, q.queries, b.ndcg AS baseline_ndcg, b.mrr AS baseline_mrr, m.ndcg AS model_ndcg, m.mrr AS model_mrr, round(m.ndcg - b.ndcg, 6) AS ndcg_delta
FROM (SELECT split, count(DISTINCT query_id) AS queries FROM v_learned GROUP BY 1) q JOIN v_means_base b USING (split) JOIN v_means_model m USING (split)""")
def learned_rerank_eval(c: Corpus):
    """Held-out metrics of the retrieval order and of a model fitted on six features."""
    shelf = R.shelf(c)
    asked = R.expand_requests(c.requests).select("query_id", "intent_days", "intent_experience", "intent_split")
    programs = shelf.programs.select("program_id", F.col("page_quality").alias("q1"), "confidence", "p_days_per_week", "p_experience_level", "p_split_type")
    sources = shelf.sources.select("source_id", F.col("page_quality").alias("q2"))
    found = CL.retrieved(c)
    by_program = found.where("program_id IS NOT NULL").select("query_id", "program_id", F.col("text_rank").alias("r1"), F.col("leg").alias("l1"))
    by_source = found.where("source_id IS NOT NULL").select("query_id", "source_id", F.col("text_rank").alias("r2"), F.col("leg").alias("l2"))
    rows = CL.labels(c).join(CL.train_split_of(c), "query_id").join(asked, "query_id")
    rows = rows.join(CL.bootstrap(c).select("query_id", "candidate_no", F.col("score").alias("text_overlap")), ["query_id", "candidate_no"])
    rows = rows.join(by_program, ["query_id", "program_id"], "left").join(by_source, ["query_id", "source_id"], "left")
    rows = rows.join(programs, "program_id", "left").join(sources, "source_id", "left")
    intent = sum((F.when(F.col(f"p_{f}") == F.col(wish), points).otherwise(0) for f, wish, points in SH.INTENTS), F.lit(0))
    rows = rows.select(
        "query_id", "split", "candidate_no", "baseline_rank", "relevance", "reason", "text_overlap", "confidence", intent.alias("intent"),
        F.coalesce("r1", "r2").alias("text_rank"), F.coalesce("q1", "q2").alias("page_quality"), F.coalesce("l1", "l2").alias("leg"),
    )
    return LR.fit_and_evaluate(c.stage(rows, "features"))
