"""URL operators, discovery and corpus maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.functions import fixed_values as V
from quarrylight.functions import urls as U
from quarrylight.operators import discovery as D
from quarrylight.operators import maintain as M
from quarrylight.operators import normalize as N
from quarrylight.plans import sqltext as S
from quarrylight.plans.catalog_normalize import normalized
from quarrylight.plans.catalog_views import iso
from quarrylight.plans.oracle_views import view
from quarrylight.plans.registry import query
from quarrylight.sources.corpus import Corpus, day, plus_seconds


@query("canonicalize_urls", f"SELECT page_id, pos, {S.canonical('raw_url')} AS canonical_url FROM v_candidates")
def canonicalize_urls(c: Corpus):
    return c.candidates.select("page_id", F.col("pos").cast("long").alias("pos"), U.canonicalize_url(F.col("raw_url")).alias("canonical_url"))


view("v_safe", f"SELECT page_id, pos, page_id * 10 + pos AS seq, raw_url, {S.safe_canonical('raw_url')} AS canonical_url FROM v_candidates")


def safe(c: Corpus):
    return c.candidates.select(
        "page_id", F.col("pos").cast("long").alias("pos"), (F.col("page_id") * 10 + F.col("pos")).alias("seq"), "raw_url",
        U.safe_canonicalize_url(F.col("raw_url")).alias("canonical_url"),
    )


@query("safe_canonical", "SELECT * FROM v_safe")
def safe_canonical(c: Corpus):
    return safe(c)


@query("url_domain", f"""
SELECT page_id, pos, coalesce(nullif({S.netloc('raw_url')}, ''), 'unknown') AS domain FROM v_candidates""")
def url_domain(c: Corpus):
    return c.candidates.select("page_id", F.col("pos").cast("long").alias("pos"), U.domain_of_url(F.col("raw_url")).alias("domain"))


@query("url_domain_match", f"""
SELECT s.seq, s.canonical_url, d.domain FROM (SELECT *, {S.netloc('canonical_url')} AS host FROM v_safe WHERE canonical_url IS NOT NULL) s
JOIN v_domains d ON s.host = d.domain OR ends_with(s.host, '.' || d.domain)""")
def url_domain_match(c: Corpus):
    urls = safe(c).where("canonical_url IS NOT NULL").withColumn("host", U.netloc(F.col("canonical_url")))
    return D.match_domains(urls, c.domains).select("seq", "canonical_url", "domain")


view("v_outputs", """
SELECT page_id, CASE page_id % 4
  WHEN 0 THEN '["' || a || '", "' || b || '", "' || a || '/", ["' || b || '#x", 7]' || CASE WHEN page_id % 8 = 4 THEN ', ' || repeat('[', 12) || '"' || a || '/far"' || repeat(']', 12) ELSE '' END || ']'
  WHEN 1 THEN '{"note":"https://not.example/listed","links":["' || b || '"],"urls":["' || a || '","mailto:x@y"],"candidate_urls":"see ' || a || '?q=1 and ' || b || '/more"}'
  WHEN 2 THEN 'See ' || a || ' and <' || b || '> also ' || a || '?x=1 ' || html
  ELSE '{"candidate_urls": {"links": ["{\\"urls\\": [\\"' || b || '/deep\\"]}", "text ' || a || ', end"]}}' END AS output
FROM (SELECT page_id, html, 'https://' || host || '/a' || page_id AS a, 'HTTP://' || host || '/b/' AS b0, 'http://' || host || '/b' AS b
  FROM (SELECT page_id, html, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host FROM pages))""")


def outputs(c: Corpus):
    host = F.regexp_extract("url", r"^https?://([^/?#]*)", 1)
    p = F.col("page_id")
    a = F.concat(F.lit("https://"), host, F.lit("/a"), p)
    b = F.concat(F.lit("http://"), host, F.lit("/b"))
    deep = F.when(p % 8 == 4, F.concat(F.lit(", " + "[" * 12 + '"'), a, F.lit('/far"' + "]" * 12))).otherwise("")
    output = (
        F.when(p % 4 == 0, F.concat(F.lit('["'), a, F.lit('", "'), b, F.lit('", "'), a, F.lit('/", ["'), b, F.lit('#x", 7]'), deep, F.lit("]")))
        .when(p % 4 == 1, F.concat(
            F.lit('{"note":"https://not.example/listed","links":["'), b, F.lit('"],"urls":["'), a,
            F.lit('","mailto:x@y"],"candidate_urls":"see '), a, F.lit("?q=1 and "), b, F.lit('/more"}')))
        .when(p % 4 == 2, F.concat(F.lit("See "), a, F.lit(" and <"), b, F.lit("> also "), a, F.lit("?x=1 "), F.col("html")))
        .otherwise(F.concat(
            F.lit('{"candidate_urls": {"links": ["{\\"urls\\": [\\"'), b, F.lit('/deep\\"]}", "text '), a, F.lit(', end"]}}')))
    )
    return c.raw("pages").select("page_id", output.alias("output"))


_re = "https?://[^\\s\"''<>]+"
_json_text = f"regexp_extract_all(json_extract_string(v, '%s'), '{_re}')"


view("v_found_urls", f"""
WITH o AS (SELECT page_id, output, CASE WHEN page_id % 4 <> 2 THEN CAST(output AS JSON) END AS v FROM v_outputs),
u AS (SELECT page_id, CASE page_id % 4
    WHEN 2 THEN regexp_extract_all(output, '{_re}')
    WHEN 0 THEN list_concat(list_concat(list_filter(json_extract_string(v, '$[*]'), lambda x: NOT starts_with(x, '[')), json_extract_string(v, '$[3][*]')),
      CASE WHEN page_id % 8 = 4 THEN [json_extract_string(v, '$[4]{"[0]" * 12}')] END)
    WHEN 1 THEN list_concat(json_extract_string(v, '$.urls[*]'), {_json_text % '$.candidate_urls'}, json_extract_string(v, '$.links[*]'))
    ELSE list_concat(regexp_extract_all(json_extract_string(v, '$.candidate_urls.links[0]'), '{_re.replace("<>", "<>")}'),
      {_json_text % '$.candidate_urls.links[1]'}) END AS us FROM o),
x AS (SELECT page_id, unnest(us) AS raw, generate_subscripts(us, 1) AS n FROM u),
y AS (SELECT page_id, n, CASE WHEN regexp_matches(raw, '^https?://') THEN {S.safe_canonical('raw')} END AS canonical_url FROM x),
z AS (SELECT page_id, canonical_url, min(n) AS n FROM y WHERE canonical_url IS NOT NULL GROUP BY 1, 2)
SELECT page_id, canonical_url, row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS pos FROM z""")


@query("extract_candidate_urls", "SELECT * FROM v_found_urls")
def extract_candidate_urls(c: Corpus):
    return D.extract_candidates(outputs(c), "page_id").withColumn("pos", F.col("pos").cast("long"))


@query("url_policy_filter", f"""
SELECT seq, canonical_url, {S.allowed_url('canonical_url')} AS allowed FROM v_safe WHERE canonical_url IS NOT NULL""")
def url_policy_filter(c: Corpus):
    rows = safe(c).where("canonical_url IS NOT NULL")
    return rows.select("seq", "canonical_url", U.is_allowed_candidate(F.col("canonical_url")).alias("allowed"))


@query("url_policy_cap", f"""
WITH s AS (SELECT canonical_url, min(seq) AS seq FROM v_safe WHERE canonical_url IS NOT NULL GROUP BY 1),
a AS (SELECT s.seq, u.domain, s.canonical_url, {S.allowed_url('s.canonical_url')} AS allowed FROM s JOIN v_page_urls u ON u.page_id = s.seq // 10),
b AS (SELECT *, coalesce(sum(CASE WHEN allowed THEN 1 ELSE 0 END) OVER (PARTITION BY domain ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM a)
SELECT seq, domain, canonical_url, allowed AND earlier < 2 AS accepted FROM b""")
def url_policy_cap(c: Corpus):
    rows = safe(c).where("canonical_url IS NOT NULL").groupBy("canonical_url").agg(F.min("seq").alias("seq"))
    rows = rows.withColumn("page_id", F.floor(F.col("seq") / 10)).join(c.page_urls.select("page_id", "domain"), "page_id")
    rows = rows.withColumn("allowed", U.is_allowed_candidate(F.col("canonical_url")))
    return D.apply_cap(rows, cap=2).select("seq", "domain", "canonical_url", "accepted")


view("v_batch", """
SELECT s.seq, s.raw_url, s.canonical_url, CASE WHEN s.page_id % 9 = 0 THEN 'missing.example' WHEN s.page_id % 9 = 1 THEN o.domain ELSE u.domain END AS domain
FROM v_safe s JOIN v_page_urls u USING (page_id) JOIN v_page_urls o ON o.page_id = s.page_id % 5""")


def batch(c: Corpus):
    home = c.page_urls.select("page_id", F.col("domain").alias("own"))
    other = c.page_urls.select(F.col("page_id").alias("other_id"), F.col("domain").alias("other"))
    rows = safe(c).drop("canonical_url").withColumn("other_id", F.col("page_id") % 5).join(home, "page_id").join(other, "other_id")
    p = F.col("page_id")
    domain = F.when(p % 9 == 0, "missing.example").when(p % 9 == 1, F.col("other")).otherwise(F.col("own"))
    return rows.select("seq", "raw_url", domain.alias("domain"))


@query("create_sources", f"""
WITH r AS (SELECT b.*, CASE WHEN d.domain IS NULL THEN 'domain_not_found' WHEN b.canonical_url IS NULL THEN 'invalid_url'
    WHEN NOT ({S.netloc('b.canonical_url')} = b.domain OR ends_with({S.netloc('b.canonical_url')}, '.' || b.domain)) THEN 'off_domain'
    WHEN k.canonical_url IS NOT NULL THEN 'duplicate' END AS reason
  FROM v_batch b LEFT JOIN v_domains d ON d.domain = b.domain
  LEFT JOIN (SELECT canonical_url FROM v_sources) k ON k.canonical_url = b.canonical_url)
SELECT seq, domain, raw_url, canonical_url, coalesce(reason, CASE WHEN seq = min(seq) FILTER (WHERE reason IS NULL) OVER (PARTITION BY canonical_url)
  THEN 'created' ELSE 'duplicate' END) AS outcome FROM r""")
def create_sources(c: Corpus):
    return D.create_sources(batch(c), c.domains, c.sources)


# -- discovery batches -------------------------------------------------------------
#: So few URLs of a job are accepted here, for some to be left.
BATCH_CAP = 2
view("v_discover_jobs", r"""
SELECT page_id AS job_id, CASE WHEN page_id % 9 = 4 THEN regexp_replace(domain, '^[^.]*\.', '') ELSE domain END AS domain FROM v_page_urls""")
view("v_discover_states", f"""
WITH a AS (SELECT id % p.n AS job_id, id // p.n AS attempt, error_message AS message,
    coalesce(error_type IN ({S.quoted(V.RETRYABLE_ERROR_TYPES)}), false) AS again FROM v_crawl_jobs, (SELECT count(*) AS n FROM pages) p WHERE id // p.n <= {V.MAX_RETRIES}),
f AS (SELECT job_id, min(attempt) FILTER (WHERE message IS NULL OR NOT again OR attempt = {V.MAX_RETRIES}) AS ended, max(attempt) AS newest FROM a GROUP BY 1)
SELECT job_id, CASE WHEN ended IS NULL THEN 'running' WHEN message IS NULL THEN 'succeeded' ELSE 'failed' END AS status,
  CASE WHEN ended IS NULL THEN attempt + 1 ELSE attempt END AS retry_count,
  CASE WHEN ended IS NULL THEN 'discover attempt ' || (attempt + 1) || '/{V.MAX_RETRIES + 1} failed: ' || message || '; retrying'
    WHEN message IS NOT NULL THEN 'discover failed after ' || (attempt + 1) || '/{V.MAX_RETRIES + 1} attempts: ' || message END AS error_message
FROM f JOIN a USING (job_id) WHERE attempt = coalesce(ended, newest)""")
view("v_discovered", f"""
WITH c AS (SELECT job_id, domain, pos, canonical_url, coalesce({S.netloc('canonical_url')} = domain OR ends_with({S.netloc('canonical_url')}, '.' || domain), false) AS inside,
    {S.allowed_url('canonical_url')} AS allowed
  FROM v_discover_jobs JOIN v_discover_states s USING (job_id) JOIN v_found_urls u ON u.page_id = job_id WHERE s.status = 'succeeded'),
r AS (SELECT *, sum(CASE WHEN inside AND allowed THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY pos) AS so_far FROM c),
v AS (SELECT r.*, CASE WHEN NOT inside THEN 'off_domain' WHEN NOT allowed OR so_far > {BATCH_CAP} THEN 'rejected' WHEN d.domain IS NULL THEN 'domain_not_found'
    WHEN k.canonical_url IS NOT NULL THEN 'duplicate' END AS reason
  FROM r LEFT JOIN v_domains d ON d.domain = r.domain LEFT JOIN (SELECT DISTINCT canonical_url FROM v_sources) k ON k.canonical_url = r.canonical_url)
SELECT job_id, domain, pos, canonical_url, coalesce(reason, CASE WHEN row_number() OVER (PARTITION BY canonical_url, reason IS NULL ORDER BY job_id, pos) = 1
  THEN 'created' ELSE 'duplicate' END) AS outcome FROM v""")


def discover_jobs(c: Corpus):
    """A discovery job for each page, by page id; some ask for the domain above."""
    p = F.col("page_id")
    domain = F.when(p % 9 == 4, F.regexp_replace("domain", r"^[^.]*\.", "")).otherwise(F.col("domain"))
    return c.page_urls.select(p.alias("job_id"), domain.alias("domain"))


def discover_states(c: Corpus):
    """Crawl jobs in rounds over the pages are the attempts of the pages' discovery jobs."""
    n = F.lit(c.page_count)
    return N.resolve_attempts(c.crawl_jobs.select(
        (F.col("id") % n).alias("job_id"), F.floor(F.col("id") / n).alias("attempt"), F.lit("discover").alias("job_type"),
        F.col("error_message").alias("message"), "error_type", F.lit(False).alias("invalid"),
    ))


def discovered(c: Corpus):
    with_output = outputs(c).withColumnRenamed("page_id", "job_id").join(discover_jobs(c), "job_id")
    return D.discover_batch(with_output, discover_states(c), c.domains, c.sources, BATCH_CAP)


@query("discover_batch", "SELECT * FROM v_discovered")
def discover_batch(c: Corpus):
    """Extract, domain match, policy, cap and creation of all discovery jobs as one batch."""
    return discovered(c)


@query("discover_attempts", """
SELECT j.job_id, j.domain, coalesce(s.status, 'pending') AS status, coalesce(s.retry_count, 0) AS retry_count, s.error_message,
  count(*) FILTER (WHERE outcome IN ('created', 'duplicate', 'domain_not_found')) AS accepted, count(*) FILTER (WHERE outcome = 'created') AS created,
  count(*) FILTER (WHERE outcome IN ('duplicate', 'domain_not_found', 'rejected')) AS skipped, count(*) FILTER (WHERE outcome = 'off_domain') AS off_domain
FROM v_discover_jobs j LEFT JOIN v_discover_states s USING (job_id) LEFT JOIN v_discovered d USING (job_id) GROUP BY ALL""")
def discover_attempts(c: Corpus):
    return D.discover_results(discover_jobs(c), discover_states(c), discovered(c))


@query("allowlist_gate", """
SELECT s.id, s.canonical_url FROM v_sources s JOIN v_domains d ON d.id = s.domain_id WHERE d.allowlisted AND NOT d.paused""")
def allowlist_gate(c: Corpus):
    ok = M.allowed_domains(c.domains).select(F.col("id").alias("domain_id"))
    return c.sources.join(ok, "domain_id", "left_semi").select("id", "canonical_url")


view("v_domain_log", """
SELECT e.event_id AS seq, CASE WHEN e.event_id % 10 = 9 THEN 'new-' || (e.event_id % 70) || '.example' ELSE u.domain END AS domain,
  CASE e.event_type WHEN 'signup' THEN 'add' WHEN 'error' THEN 'pause' WHEN 'view' THEN 'resume' ELSE 'note' END AS action,
  e.event_id % 4 <> 1 AS allowlisted FROM events e JOIN v_page_urls u ON u.page_id = e.event_id // 40""")


@query("domain_snapshot", """
WITH x AS (SELECT coalesce(b.domain, a.domain) AS domain, b.allowlisted AS old_allowed, b.paused AS old_paused, a.new_allowed,
    CASE WHEN b.domain IS NOT NULL THEN -1 ELSE a.first_add END AS since
  FROM v_domains b FULL JOIN (SELECT domain, min(seq) AS first_add, arg_max(allowlisted, seq) AS new_allowed FROM v_domain_log WHERE action = 'add' GROUP BY 1) a
  ON a.domain = b.domain)
SELECT x.domain, coalesce(new_allowed, old_allowed) AS allowlisted, old_allowed IS NULL AS is_new,
  coalesce((SELECT arg_max(l.action = 'pause', l.seq) FROM v_domain_log l WHERE l.domain = x.domain AND l.action IN ('pause', 'resume') AND l.seq > x.since), old_paused, false) AS paused
FROM x""")
def domain_snapshot(c: Corpus):
    e = F.col("event_id")
    ev = c.raw("events").withColumn("page_id", F.floor(e / 40)).join(c.page_urls.select("page_id", "domain"), "page_id")
    kind = F.col("event_type")
    log = ev.select(
        e.alias("seq"),
        F.when(e % 10 == 9, F.concat(F.lit("new-"), e % 70, F.lit(".example"))).otherwise(F.col("domain")).alias("domain"),
        F.when(kind == "signup", "add").when(kind == "error", "pause").when(kind == "view", "resume").otherwise("note").alias("action"),
        (e % 4 != 1).alias("allowlisted"),
    )
    return M.domain_snapshot(c.domains, log)


@query("apply_extractions", f"""
WITH b AS (SELECT 1000000 + document_id AS document_id, source_id, title, author, source_type,
    TIMESTAMP '2024-02-01 00:00:00' + to_minutes(document_id % 3) AS at_time
  FROM v_normalized WHERE validation_errors = ''),
n AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY at_time DESC, document_id DESC) = 1)
SELECT s.id, s.canonical_url, CASE WHEN n.source_id IS NULL THEN s.title ELSE n.title END AS title,
  CASE WHEN n.source_id IS NULL THEN s.author ELSE n.author END AS author,
  CASE WHEN n.source_id IS NULL THEN s.source_type ELSE n.source_type END AS source_type,
  CASE WHEN n.source_id IS NULL THEN s.status ELSE 'succeeded' END AS status,
  {S.iso('CASE WHEN n.source_id IS NULL THEN s.last_crawled_at ELSE n.at_time END')} AS last_crawled_at,
  CASE WHEN n.source_id IS NULL THEN s.latest_document_id ELSE n.document_id END AS latest_document_id
FROM v_sources s LEFT JOIN n ON n.source_id = s.id""")
def apply_extractions(c: Corpus):
    """Valid extractions of the batch become the newest documents."""
    d = F.col("document_id")
    made = normalized(c).where(F.size("validation_errors") == 0).select(
        (1_000_000 + d).alias("document_id"), "source_id", "title", "author", "source_type",
        plus_seconds(day("2024-02-01"), (d % 3) * 60).alias("at"),
    )
    return M.apply_extractions(c.sources, made).withColumn("last_crawled_at", iso("last_crawled_at"))


@query("crawl_stop", f"""
SELECT id, CASE WHEN stop THEN 'failed' ELSE status END AS status,
  {S.iso("CASE WHEN stop THEN TIMESTAMP '2024-02-02 00:00:00' ELSE completed_at END")} AS completed_at,
  CASE WHEN NOT stop THEN error_message WHEN coalesce(error_message, '') = '' THEN 'Stopped by operator'
    WHEN contains(error_message, ' (operator-stopped)') THEN error_message ELSE error_message || ' (operator-stopped)' END AS error_message,
  CASE WHEN NOT asked THEN NULL WHEN stop THEN 'stopped' ELSE 'no-op' END AS result
FROM (SELECT id, status, completed_at, asked, asked AND status IN ('pending', 'running') AS stop,
    CASE WHEN status = 'running' AND id % 100 = 0 THEN 'extract attempt 1/3 failed' WHEN status = 'running' THEN 'slow (operator-stopped)' ELSE error_message END AS error_message
  FROM (SELECT *, id % 5 = 0 OR id % 7 = 0 AS asked FROM v_crawl_jobs))""")
def crawl_stop(c: Corpus):
    i = F.col("id")
    running = F.col("status") == "running"
    message = F.when(running & (i % 100 == 0), "extract attempt 1/3 failed").when(running, "slow (operator-stopped)").otherwise(F.col("error_message"))
    jobs = c.crawl_jobs.withColumn("error_message", message)
    asked = c.crawl_jobs.where((i % 5 == 0) | (i % 7 == 0)).select(i.alias("crawl_id"))
    return M.stop_crawls(jobs, asked, day("2024-02-02")).withColumn("completed_at", iso("completed_at"))
