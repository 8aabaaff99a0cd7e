"""Operations analytics: backlog, quality, admission, plans, runs, dashboard."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.functions import fixed_values as V
from quarrylight.operators import admission as AD
from quarrylight.operators import planning as PL
from quarrylight.operators import runs as RU
from quarrylight.plans import sqltext as S
from quarrylight.plans.catalog_normalize import NEW_IDS, normalized
from quarrylight.plans.catalog_views import iso
from quarrylight.plans.oracle_views import view
from quarrylight.plans.registry import query
from quarrylight.sources import policies as PO
from quarrylight.sources.corpus import Corpus, day

NOW = "2024-01-31 00:00:00"

view("v_policies", """
SELECT domain, CASE WHEN id % 5 = 0 THEN [] ELSE ['https://' || domain || '/start', ' https://' || domain || '/more '] END AS seed_urls,
  CASE WHEN id % 3 = 0 THEN id % 4 END AS per_domain_limit, CASE WHEN id % 6 = 3 THEN 9 END AS stale_after_days,
  CASE id % 6 WHEN 1 THEN 2 WHEN 5 THEN 1 END AS admission_min_succeeded_sources,
  CASE id % 6 WHEN 2 THEN id % 4 WHEN 5 THEN 5 END AS admission_recent_crawl_window,
  CASE id % 6 WHEN 2 THEN 0.2::DOUBLE WHEN 5 THEN 0.9::DOUBLE END AS admission_max_recent_failure_rate,
  CASE id % 6 WHEN 3 THEN 0.7::DOUBLE WHEN 5 THEN 0.1::DOUBLE END AS admission_min_avg_parse_confidence,
  CASE id % 6 WHEN 4 THEN 0.3::DOUBLE WHEN 5 THEN 0.99::DOUBLE END AS admission_max_zero_program_rate
FROM v_domains WHERE id % 8 <> 7""")


def policies(c: Corpus):
    return c.keep("policies", lambda: PO.load_policies(c.policy_files))


@query("policy_load", "SELECT * REPLACE (array_to_string(seed_urls, '|') AS seed_urls) FROM v_policies")
def policy_load(c: Corpus):
    return PO.load_policies(c.policy_files).withColumn("seed_urls", F.array_join("seed_urls", "|"))


@query("backlog_report", f"""
WITH s AS (SELECT s.*, d.domain, s.status = 'succeeded' AND (last_crawled_at IS NULL OR last_crawled_at < TIMESTAMP '{NOW}' - INTERVAL 14 DAY) AS stale
  FROM v_sources s JOIN v_domains d ON d.id = s.domain_id),
p AS (SELECT domain, string_agg(id || ' ' || canonical_url, '|' ORDER BY id) AS pending_samples FROM (
  SELECT *, row_number() OVER (PARTITION BY domain ORDER BY id) AS r FROM s WHERE status = 'pending') WHERE r <= 5 GROUP BY 1),
g AS (SELECT coalesce(domain, '(all)') AS domain, count(*) AS sources_total, count(*) FILTER (WHERE status = 'pending') AS pending,
  count(*) FILTER (WHERE status = 'succeeded') AS succeeded, count(*) FILTER (WHERE status = 'failed') AS failed,
  count(*) FILTER (WHERE stale) AS stale_succeeded FROM s GROUP BY ROLLUP (domain))
SELECT g.*, coalesce(p.pending_samples, '') AS pending_samples FROM g LEFT JOIN p USING (domain)""")
def backlog_report(c: Corpus):
    rows = AD.backlog_report(c, day(NOW))
    shown = F.transform("pending_samples", lambda s: F.concat_ws(" ", s["id"].cast("string"), s["canonical_url"]))
    return rows.withColumn("domain", F.coalesce("domain", F.lit("(all)"))).withColumn(
        "pending_samples", F.coalesce(F.array_join(shown, "|"), F.lit(""))
    ).drop("is_total")


view("v_recent", f"""
SELECT d.id AS domain_id, d.domain, greatest(1, coalesce(p.admission_recent_crawl_window, {V.RECENT_WINDOW})) AS recent_crawl_window,
  coalesce(x.attempted, 0) AS recent_attempted_crawls, coalesce(x.failed, 0) AS recent_failed_crawls,
  round(CASE WHEN x.attempted > 0 THEN x.failed / x.attempted::DOUBLE END, 6) AS recent_failure_rate
FROM v_domains d LEFT JOIN v_policies p USING (domain)
LEFT JOIN (SELECT domain_id, count(*) FILTER (WHERE status IN ('succeeded', 'failed')) AS attempted, count(*) FILTER (WHERE status = 'failed') AS failed
  FROM (SELECT s.domain_id, j.status, greatest(1, coalesce(p.admission_recent_crawl_window, {V.RECENT_WINDOW})) AS w,
      row_number() OVER (PARTITION BY s.domain_id ORDER BY j.started_at DESC NULLS FIRST, j.id DESC) AS r
    FROM v_crawl_jobs j JOIN v_sources s ON s.id = j.source_id JOIN v_domains d ON d.id = s.domain_id LEFT JOIN v_policies p USING (domain))
  WHERE r <= w GROUP BY 1) x ON x.domain_id = d.id""")
view("v_quality", """
SELECT r.domain_id, r.domain, coalesce(q.succeeded, 0) AS succeeded_sources, r.recent_crawl_window, r.recent_attempted_crawls, r.recent_failed_crawls,
  r.recent_failure_rate, round(q.conf, 10) AS avg_parse_confidence, coalesce(q.with_docs, 0) AS succeeded_with_documents,
  coalesce(q.zero, 0) AS zero_program_succeeded_sources, round(CASE WHEN q.with_docs > 0 THEN q.zero / q.with_docs::DOUBLE END, 6) AS zero_program_rate
FROM v_recent r LEFT JOIN (SELECT s.domain_id, count(*) AS succeeded, avg(d.parse_confidence) AS conf, count(s.latest_document_id) AS with_docs,
    count(*) FILTER (WHERE s.latest_document_id IS NOT NULL AND s.latest_document_id NOT IN (SELECT document_id FROM v_programs)) AS zero
  FROM v_sources s LEFT JOIN v_documents d ON d.id = s.latest_document_id WHERE s.status = 'succeeded' GROUP BY 1) q USING (domain_id)""")
view("v_admissions", """
SELECT q.*, d.allowlisted, d.paused, p.domain IS NOT NULL AS policy_present, p.per_domain_limit, p.seed_urls,
  p.admission_min_succeeded_sources, p.admission_max_recent_failure_rate, p.admission_min_avg_parse_confidence, p.admission_max_zero_program_rate,
  coalesce(p.admission_min_succeeded_sources, p.admission_max_recent_failure_rate, p.admission_min_avg_parse_confidence, p.admission_max_zero_program_rate) IS NOT NULL AS admission_policy_enabled,
  CASE WHEN succeeded_sources < admission_min_succeeded_sources THEN 'domain_quality_insufficient_succeeded_sources'
    WHEN admission_max_recent_failure_rate IS NOT NULL AND recent_failure_rate IS NULL THEN 'domain_quality_insufficient_recent_crawl_history'
    WHEN recent_failure_rate > admission_max_recent_failure_rate THEN 'domain_quality_recent_failure_rate_exceeded'
    WHEN admission_min_avg_parse_confidence IS NOT NULL AND avg_parse_confidence IS NULL THEN 'domain_quality_missing_parse_confidence'
    WHEN avg_parse_confidence < admission_min_avg_parse_confidence THEN 'domain_quality_low_parse_confidence'
    WHEN admission_max_zero_program_rate IS NOT NULL AND zero_program_rate IS NULL THEN 'domain_quality_missing_zero_program_rate'
    WHEN zero_program_rate > admission_max_zero_program_rate THEN 'domain_quality_high_zero_program_rate' END AS admission_block_reason
FROM v_quality q JOIN v_domains d ON d.id = q.domain_id LEFT JOIN v_policies p ON p.domain = q.domain""")


@query("recent_failures", "SELECT * FROM v_recent")
def recent_failures(c: Corpus):
    return AD.recent_failures(c, policies(c))


@query("domain_quality", "SELECT * FROM v_quality")
def domain_quality(c: Corpus):
    return AD.domain_quality(c, policies(c))


@query("admission_decisions", """
SELECT domain, admission_block_reason IS NULL AS admitted, admission_block_reason, policy_present, admission_policy_enabled FROM v_admissions""")
def admission_decisions(c: Corpus):
    return AD.admissions(c, policies(c)).select(
        "domain", "admitted", "admission_block_reason", "policy_present", "admission_policy_enabled"
    )


@query("domain_quality_report", """
SELECT * EXCLUDE (per_domain_limit, seed_urls, domain_id), admission_block_reason IS NULL AS admitted FROM v_admissions""")
def domain_quality_report(c: Corpus):
    return AD.admissions(c, policies(c)).drop("per_domain_limit", "seed_urls", "domain_id")


@query("domain_quality_totals", """
SELECT count(*) AS domains_count, count(*) FILTER (WHERE admission_block_reason IS NULL) AS admitted,
  count(*) FILTER (WHERE admission_block_reason IS NOT NULL) AS blocked FROM v_admissions""")
def domain_quality_totals(c: Corpus):
    return AD.quality_totals(AD.admissions(c, policies(c)))


# -- planning ----------------------------------------------------------------
view("v_requested", """
SELECT id AS pos, CASE WHEN id % 9 = 4 THEN ' Gone-' || id || '.example' WHEN id % 9 = 5 THEN ' ' || upper(domain) || ' ' ELSE domain END AS name FROM v_domains""")
view("v_runnable", """
SELECT r.pos, lower(trim(r.name)) AS domain, d.id AS domain_id, CASE WHEN d.id IS NULL THEN 'domain_not_found' WHEN NOT d.allowlisted THEN 'domain_not_allowlisted'
  WHEN d.paused THEN 'domain_paused' END AS reason FROM v_requested r LEFT JOIN v_domains d ON d.domain = lower(trim(r.name))""")
view("v_empty", """
SELECT id, domain_id, canonical_url FROM v_sources WHERE status = 'succeeded' AND latest_document_id IS NOT NULL
  AND latest_document_id NOT IN (SELECT document_id FROM v_programs)""")
view("v_plan_rows", """
SELECT *, row_number() OVER (PARTITION BY domain_id ORDER BY mode, id) AS place FROM (
  SELECT id, domain_id, canonical_url, 'extract_pending' AS mode FROM v_sources WHERE status = 'pending'
  UNION ALL SELECT id, domain_id, canonical_url, 'refresh_empty' FROM v_empty)""")
view("v_active", """
SELECT domain, id AS crawl_id, status AS crawl_status FROM (
  SELECT d.domain, 1 AS kind, j.id, j.status, j.started_at FROM v_crawl_jobs j JOIN v_sources s ON s.id = j.source_id JOIN v_domains d ON d.id = s.domain_id
  WHERE j.status IN ('pending', 'running')
  UNION ALL
  SELECT d.domain, 0, j.id, j.status, j.started_at FROM (SELECT *, regexp_extract(target_url, '^https?://([^/]*)', 1) AS host FROM v_crawl_jobs
    WHERE source_id IS NULL AND status IN ('pending', 'running')) j JOIN v_domains d ON j.host = d.domain OR ends_with(j.host, '.' || d.domain))
QUALIFY row_number() OVER (PARTITION BY domain ORDER BY kind DESC, started_at DESC NULLS FIRST, id DESC) = 1""")


def requested(c: Corpus):
    i = F.col("id")
    name = (
        F.when(i % 9 == 4, F.concat(F.lit(" Gone-"), i, F.lit(".example")))
        .when(i % 9 == 5, F.concat(F.lit(" "), F.upper("domain"), F.lit(" "))).otherwise(F.col("domain"))
    )
    return c.domains.select(i.alias("pos"), name.alias("name"))


@query("runnable_domains", "SELECT pos, domain, reason FROM v_runnable")
def runnable_domains(c: Corpus):
    return PL.runnable_domains(requested(c), c.domains).select("pos", "domain", "reason")


@query("crawl_plan", """
WITH c AS (SELECT d.id AS domain_id, d.domain, least(CASE WHEN p.per_domain_limit IS NOT NULL THEN greatest(1, p.per_domain_limit) ELSE 10 END, 50) AS cap
  FROM v_domains d LEFT JOIN v_policies p USING (domain) WHERE d.allowlisted AND NOT d.paused),
r AS (SELECT c.domain, x.id AS source_id, x.canonical_url, x.mode, row_number() OVER (ORDER BY c.domain, x.place) AS seq
  FROM v_plan_rows x JOIN c USING (domain_id) WHERE x.place <= c.cap)
SELECT * FROM r WHERE seq <= 50""")
def crawl_plan(c: Corpus):
    ok = c.domains.where("allowlisted AND NOT paused").select(F.col("id").alias("domain_id"), "domain")
    plan = PL.crawl_plan(c, ok, policies(c))
    return plan.select("domain", F.col("id").alias("source_id"), "canonical_url", "mode", "seq")


@query("empty_program_sources", "SELECT d.domain, e.id, e.canonical_url FROM v_empty e JOIN v_domains d ON d.id = e.domain_id")
def empty_program_sources(c: Corpus):
    d = c.domains.select(F.col("id").alias("domain_id"), "domain")
    return PL.empty_sources(c).join(d, "domain_id").select("domain", "id", "canonical_url")


@query("active_crawls", "SELECT * FROM v_active")
def active_crawls(c: Corpus):
    return PL.active_crawls(c)


ENTRIES = ["https://start.example/all", "  ", "gone.example=https://x", " https://start.example/all "]
view("v_seeds", """
SELECT d.domain, ['https://start.example/all'] || list_transform(coalesce(p.seed_urls, []), lambda s: trim(s)) AS seeds
FROM v_domains d LEFT JOIN v_policies p USING (domain)""")


@query("seed_urls", "SELECT domain, array_to_string(seeds, '|') AS seeds, len(seeds) AS n FROM v_seeds")
def seed_urls(c: Corpus):
    rows = PL.seed_urls(c.domains, policies(c), ENTRIES)
    return rows.select("domain", F.array_join("seeds", "|").alias("seeds"), F.size("seeds").cast("long").alias("n"))


@query("run_items_dry", """
WITH run AS (SELECT r.pos, r.domain, r.domain_id, a.admission_block_reason, x.crawl_id, len(coalesce(p.seed_urls, [])) AS n_seeds,
    least(CASE WHEN p.per_domain_limit IS NOT NULL THEN greatest(1, p.per_domain_limit) ELSE 10 END, 50) AS cap
  FROM v_runnable r JOIN v_admissions a ON a.domain = r.domain LEFT JOIN v_active x ON x.domain = r.domain LEFT JOIN v_policies p ON p.domain = r.domain
  WHERE r.reason IS NULL),
plan AS (SELECT * FROM (SELECT run.pos, run.domain, x.id, x.mode, row_number() OVER (ORDER BY run.pos, x.place) AS seq
  FROM run JOIN v_plan_rows x USING (domain_id) WHERE admission_block_reason IS NULL AND crawl_id IS NULL AND x.place <= run.cap) WHERE seq <= 50),
reached AS (SELECT * FROM run WHERE pos <= coalesce((SELECT max(pos) FROM plan HAVING count(*) >= 50), pos))
SELECT 'domain_gate' AS item_type, NULL AS mode, domain, NULL::BIGINT AS source_id, 'blocked' AS status, 'blocked_' || reason AS error_code, 'blocked' AS error_kind, NULL::BIGINT AS crawl_id
FROM v_runnable WHERE reason IS NOT NULL
UNION ALL SELECT 'domain_gate', NULL, domain, NULL, 'blocked', 'blocked_' || admission_block_reason, 'blocked', NULL FROM reached WHERE admission_block_reason IS NOT NULL
UNION ALL SELECT 'domain_gate', NULL, domain, NULL, 'blocked', 'blocked_active_crawl', 'blocked', crawl_id FROM reached WHERE admission_block_reason IS NULL AND crawl_id IS NOT NULL
UNION ALL SELECT 'discover', NULL, domain, NULL, 'skipped', CASE WHEN n_seeds > 0 THEN 'dry_run' ELSE 'no_seed_urls' END, 'terminal', NULL FROM reached WHERE admission_block_reason IS NULL AND crawl_id IS NULL
UNION ALL SELECT mode, mode, domain, id, 'skipped', 'dry_run', 'terminal', NULL FROM plan""")
def run_items_dry(c: Corpus):
    decided = AD.admissions(c, policies(c))
    return PL.dry_run_items(c, requested(c), policies(c), decided, [])


# -- runs --------------------------------------------------------------------
view("v_run_items", f"""
SELECT id // 100 AS run_id, id AS item_id, kind AS item_type, CASE WHEN job_type = 'extract' THEN kind END AS mode,
  CASE WHEN job_type = 'extract' THEN domain WHEN id % 4 <> 0 THEN regexp_extract(target_url, '^https?://([^/]*)', 1) END AS domain, state AS status,
  CASE WHEN kind = 'domain_gate' THEN (CASE WHEN id % 2 = 0 THEN 'blocked_active_crawl' ELSE 'blocked_domain_paused' END)
    WHEN state = 'skipped' THEN 'dry_run' WHEN state IN ('failed', 'blocked') THEN {S.error_code('error_message', 'error_type')} END AS error_code,
  CASE WHEN state = 'succeeded' AND job_type = 'extract' THEN coalesce(made, 0) END AS program_count,
  CASE WHEN state = 'succeeded' AND job_type = 'extract' THEN parse_confidence END AS parse_confidence,
  retry_count, cost AS cost_usd, coalesce(started_at, completed_at) AS ts
FROM (SELECT *, CASE WHEN kind = 'domain_gate' OR (status = 'failed' AND id % 7 = 0) THEN 'blocked' WHEN status IN ('failed', 'succeeded') THEN status ELSE 'skipped' END AS state
  FROM (SELECT j.*, m.domain, d.parse_confidence, p.made,
      CASE WHEN j.job_type = 'discover' AND j.id % 3 = 0 THEN 'domain_gate' WHEN j.job_type = 'discover' THEN 'discover'
        WHEN j.id % 2 = 0 THEN 'extract_pending' ELSE 'refresh_empty' END AS kind
    FROM v_crawl_jobs j LEFT JOIN v_sources s ON s.id = j.source_id LEFT JOIN v_domains m ON m.id = s.domain_id
    LEFT JOIN v_documents d ON d.crawl_job_id = j.id LEFT JOIN (SELECT document_id, count(*) AS made FROM v_programs GROUP BY 1) p ON p.document_id = d.id))""")

_src = "item_type IN ('extract_pending', 'refresh_empty')"
view("v_run_summary", f"""
SELECT a.run_id, started_at, completed_at, succeeded, failed, skipped, gates AS blocked_domain_gates, blocked_sources + gates AS blocked,
  succeeded + failed + blocked_sources + gates + skipped AS processed, programs_created_total,
  round(CASE WHEN succeeded > 0 THEN programs_created_total / succeeded::DOUBLE ELSE 0 END, 6) AS program_yield_rate, round(conf, 10) AS avg_parse_confidence,
  empty_program_successes, round(CASE WHEN succeeded + failed > 0 THEN failed / (succeeded + failed)::DOUBLE ELSE 0 END, 6) AS failure_rate,
  retry_events, timeout_count, coalesce(e.top_error_codes, '') AS top_error_codes, round(cost, 6) AS cost_usd_total,
  round(CASE WHEN succeeded > 0 THEN cost / succeeded END, 10) AS avg_cost_per_success,
  succeeded + failed > 0 AND failed / (succeeded + failed)::DOUBLE > {V.FAILURE_RATE_THRESHOLD} AS should_fail
FROM (SELECT run_id, count(*) FILTER (WHERE {_src} AND status = 'succeeded') AS succeeded, count(*) FILTER (WHERE {_src} AND status = 'failed') AS failed,
    count(*) FILTER (WHERE {_src} AND status = 'blocked') AS blocked_sources, count(*) FILTER (WHERE {_src} AND status = 'skipped') AS skipped,
    count(*) FILTER (WHERE item_type = 'domain_gate' AND status = 'blocked') AS gates,
    CAST(coalesce(sum(program_count) FILTER (WHERE {_src} AND status = 'succeeded'), 0) AS BIGINT) AS programs_created_total,
    avg(parse_confidence) FILTER (WHERE {_src} AND status = 'succeeded') AS conf,
    count(*) FILTER (WHERE {_src} AND mode = 'refresh_empty' AND status = 'succeeded' AND program_count > 0) AS empty_program_successes,
    CAST(sum(coalesce(retry_count, 0)) AS BIGINT) AS retry_events, count(*) FILTER (WHERE error_code = 'timeout') AS timeout_count,
    sum(coalesce(cost_usd, 0)) AS cost, min(ts) AS started_at, max(ts) AS completed_at FROM v_run_items GROUP BY 1) a
LEFT JOIN (SELECT run_id, string_agg(error_code || ':' || n, ',' ORDER BY n DESC, error_code) AS top_error_codes FROM (
    SELECT run_id, error_code, count(*) AS n FROM v_run_items WHERE status IN ('failed', 'blocked') AND coalesce(error_code, '') <> '' GROUP BY 1, 2
    QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY count(*) DESC, error_code) <= 5) GROUP BY 1) e USING (run_id)""")


@query("run_items", f"SELECT * EXCLUDE (ts), {S.iso('ts')} AS logged_at FROM v_run_items")
def run_items(c: Corpus):
    return c.run_items.withColumn("logged_at", iso("at")).drop("at")


@query("run_summary", f"SELECT * REPLACE ({S.iso('started_at')} AS started_at, {S.iso('completed_at')} AS completed_at) FROM v_run_summary")
def run_summary(c: Corpus):
    rows = RU.run_summary(c.run_items)
    return rows.withColumn("started_at", iso("started_at")).withColumn("completed_at", iso("completed_at"))


@query("run_by_domain", f"""
SELECT run_id, coalesce(nullif(domain, ''), 'unknown') AS domain, count(*) FILTER (WHERE {_src}) AS queued, count(*) AS processed,
  count(*) FILTER (WHERE status = 'succeeded') AS succeeded, count(*) FILTER (WHERE status = 'failed') AS failed,
  count(*) FILTER (WHERE status = 'blocked') AS blocked, count(*) FILTER (WHERE status = 'skipped') AS skipped,
  CAST(sum(CASE WHEN {_src} THEN coalesce(retry_count, 0) ELSE 0 END) AS BIGINT) AS retry_events,
  round(sum(CASE WHEN {_src} THEN coalesce(cost_usd, 0) ELSE 0 END), 6) AS cost_usd_total
FROM v_run_items WHERE status IN ('succeeded', 'failed', 'blocked', 'skipped') GROUP BY 1, 2""")
def run_by_domain(c: Corpus):
    return RU.run_by_domain(c.run_items)


_sums = ", ".join(
    f"CAST(coalesce(sum({n}), 0) AS BIGINT) AS {n}" for n in ("processed", "succeeded", "failed", "blocked", "blocked_domain_gates", "skipped")
)


@query("run_history", f"""
SELECT count(*) AS runs_analyzed, arg_max(run_id, struct_pack(a := completed_at, b := run_id)) AS latest_run_id, {_sums},
  round(coalesce(sum(cost_usd_total), 0), 6) AS cost_usd_total, round(coalesce(avg(failure_rate), 0), 10) AS avg_failure_rate,
  coalesce(max(failure_rate), 0) AS max_failure_rate, coalesce((SELECT string_agg(code || ':' || n, ',' ORDER BY n DESC, code) FROM (
    SELECT split_part(part, ':', 1) AS code, CAST(sum(CAST(split_part(part, ':', 2) AS BIGINT)) AS BIGINT) AS n
    FROM (SELECT unnest(string_split(top_error_codes, ',')) AS part FROM v_run_summary WHERE top_error_codes <> '') GROUP BY 1 ORDER BY n DESC, code LIMIT 5)), '') AS top_error_codes
FROM v_run_summary""")
def run_history(c: Corpus):
    return RU.run_history(RU.run_summary(c.run_items))


@query("dashboard", f"""
SELECT * FROM (SELECT count(*) AS domains_total, count(*) FILTER (WHERE allowlisted) AS allowlisted_domains, count(*) FILTER (WHERE paused) AS paused_domains FROM v_domains),
 (SELECT count(*) AS sources_total, count(*) FILTER (WHERE status = 'pending') AS sources_pending, count(*) FILTER (WHERE status = 'succeeded') AS sources_succeeded,
   count(*) FILTER (WHERE status = 'failed') AS sources_failed FROM v_sources),
 (SELECT count(*) AS documents_total FROM v_documents), (SELECT count(*) AS programs_total FROM v_programs), (SELECT count(*) AS claims_total FROM v_claim_refs),
 (SELECT {S.iso("max(started_at) FILTER (WHERE status = 'succeeded')")} AS latest_successful_crawl_at FROM v_crawl_jobs),
 (SELECT count(*) AS recent_crawls_analyzed, count(*) FILTER (WHERE status = 'failed') AS recent_crawls_failed FROM (
   SELECT status FROM v_crawl_jobs ORDER BY started_at DESC NULLS FIRST, id DESC LIMIT 20))""")
def dashboard(c: Corpus):
    return RU.dashboard(c).withColumn("latest_successful_crawl_at", iso("latest_successful_crawl_at"))


# -- re-extract batches ------------------------------------------------------------
view("v_reextract", f"""
WITH q AS (SELECT d.domain, e.id AS source_id FROM v_empty e JOIN v_domains d ON d.id = e.domain_id WHERE d.domain NOT IN (SELECT domain FROM v_active)
  QUALIFY row_number() OVER (PARTITION BY d.domain ORDER BY e.id) <= {V.REEXTRACT_LIMIT}),
a AS (SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY id) - 1 AS attempt, error_message AS message,
    coalesce(error_type IN ({S.quoted(V.RETRYABLE_ERROR_TYPES)}), false) OR coalesce(error_message IN ('schema_invalid', 'no_programs_on_program_page') OR error_message LIKE 'low_quality%', false) AS again
  FROM v_crawl_jobs WHERE job_type = 'extract' AND source_id IS NOT NULL QUALIFY attempt <= {V.MAX_RETRIES}),
f AS (SELECT source_id, min(attempt) AS attempt FROM a WHERE message IS NULL OR NOT again OR attempt = {V.MAX_RETRIES} GROUP BY 1),
s AS (SELECT source_id, a.attempt, a.message FROM f JOIN a USING (source_id, attempt)),
m AS (SELECT source_id, max(new_id) AS document_id FROM v_extracted GROUP BY 1)
SELECT q.domain, q.source_id, CASE WHEN s.source_id IS NULL THEN 'queued' WHEN message IS NULL THEN 'succeeded' ELSE 'failed' END AS status,
  CASE WHEN s.source_id IS NOT NULL AND message IS NULL THEN document_id END AS document_id,
  'extract failed after ' || (attempt + 1) || '/{V.MAX_RETRIES + 1} attempts: ' || message AS error
FROM q LEFT JOIN s USING (source_id) LEFT JOIN m USING (source_id)""")


def reextracted(c: Corpus):
    bad = F.col("error_message")
    invalid = bad.isin("schema_invalid", "no_programs_on_program_page") | bad.startswith("low_quality")
    jobs = c.crawl_jobs.where("job_type = 'extract' AND source_id IS NOT NULL").select(
        "id", "source_id", bad.alias("message"), "error_type", F.coalesce(invalid, F.lit(False)).alias("invalid")
    )
    made = normalized(c).where(F.size("validation_errors") == 0).groupBy("source_id").agg((F.max("document_id") + NEW_IDS).alias("document_id"))
    return PL.reextract_results(PL.reextract_queue(c), jobs, made)


@query("reextract_results", "SELECT * FROM v_reextract")
def reextract_results(c: Corpus):
    return reextracted(c)


@query("reextract_outcome", """
SELECT d.domain, a.crawl_id AS blocked_by, count(r.source_id) AS queued, count(*) FILTER (WHERE r.status IN ('succeeded', 'failed')) AS processed,
  count(*) FILTER (WHERE r.status = 'succeeded') AS succeeded, count(*) FILTER (WHERE r.status = 'failed') AS failed
FROM v_domains d LEFT JOIN v_active a USING (domain) LEFT JOIN v_reextract r USING (domain) GROUP BY ALL""")
def reextract_outcome(c: Corpus):
    return PL.reextract_outcome(c.domains, PL.active_crawls(c), reextracted(c))
