"""Scalar text operators and payload normalization."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarrylight.functions import fixed_values as V
from quarrylight.functions import text as T
from quarrylight.functions import urls as U
from quarrylight.operators import normalize as N
from quarrylight.plans import payload_views  # noqa: F401
from quarrylight.plans import sqltext as S
from quarrylight.plans.catalog_views import iso
from quarrylight.plans.oracle_views import view
from quarrylight.plans.registry import query
from quarrylight.sources import batches as BT
from quarrylight.sources.corpus import Corpus, day, plus_seconds


def normalized(c: Corpus):
    """The normalized extractions, stored once like the other corpus tables."""
    return c.keep("normalized", lambda: N.normalize(c.payloads).drop("obj"))


@query("payload_type", "SELECT document_id, payload_type FROM v_coerced")
def payload_type(c: Corpus):
    return N.coerce(c.payloads).select("document_id", "payload_type")


@query("payload_fields", "SELECT document_id, title, author, source_type, summary, raw_text FROM v_fields")
def payload_fields(c: Corpus):
    return N.fields(N.coerce(c.payloads)).select("document_id", "title", "author", "source_type", "summary", "raw_text")


@query("days_per_week", f"""
SELECT 'text' AS origin, query_id AS id, {S.days_from_text('query')} AS days_per_week FROM v_requests
UNION ALL SELECT 'document', doc_id, {S.days_from_text('text')} FROM documents
UNION ALL SELECT 'payload', document_id * 100 + pos, days_per_week FROM v_found_programs""")
def days_per_week(c: Corpus):
    texts = c.requests.select(
        F.lit("text").alias("origin"), F.col("query_id").alias("id"),
        T.days_from_text(F.col("query")).cast("long").alias("days_per_week"),
    )
    docs = c.raw("documents").select(
        F.lit("document").alias("origin"), F.col("doc_id").alias("id"),
        T.days_from_text(F.col("text")).cast("long").alias("days_per_week"),
    )
    rows = N.program_rows(normalized(c)).where("NOT programs_inferred")
    payload = rows.select(F.lit("payload").alias("origin"), (F.col("document_id") * 100 + F.col("pos")).alias("id"), "days_per_week")
    return texts.unionByName(docs).unionByName(payload)


@query("enum_normalize", f"""
SELECT doc_id, {S.enum_label('content', V.SPECIALIZATION)} AS specialization, {S.enum_label('content', V.EXPERIENCE_LEVEL)} AS experience_level,
  {S.enum_label('content', V.PROGRESSION_TYPE)} AS progression_type, {S.enum_label('content', V.SPLIT_TYPE)} AS split_type FROM v_content""")
def enum_normalize(c: Corpus):
    from quarrylight.operators.index import content

    x = F.col("content")
    return content(c.document_bodies).select(
        "doc_id", T.enum_label(x, V.SPECIALIZATION).alias("specialization"),
        T.enum_label(x, V.EXPERIENCE_LEVEL).alias("experience_level"),
        T.enum_label(x, V.PROGRESSION_TYPE).alias("progression_type"),
        T.enum_label(x, V.SPLIT_TYPE).alias("split_type"),
    )


@query("short_text", f"SELECT doc_id, {S.short_text('text')} AS short_text FROM documents")
def short_text(c: Corpus):
    return c.raw("documents").select("doc_id", T.sanitize_short_text(F.col("text")).alias("short_text"))


@query("clamp_confidence", f"""
SELECT event_id, {payload_views.clamp('TRY_CAST(t AS DOUBLE)')} AS confidence FROM (
  SELECT event_id, CASE event_id % 5 WHEN 0 THEN CAST(value / 40 AS VARCHAR) WHEN 1 THEN event_type WHEN 2 THEN 'nan'
    WHEN 3 THEN '-' || CAST(value AS VARCHAR) ELSE ' 0.25 ' END AS t FROM events)""")
def clamp_confidence(c: Corpus):
    e = F.col("event_id")
    t = (
        F.when(e % 5 == 0, (F.col("value") / 40).cast("string")).when(e % 5 == 1, F.col("event_type"))
        .when(e % 5 == 2, "nan").when(e % 5 == 3, F.concat(F.lit("-"), F.col("value").cast("string"))).otherwise(" 0.25 ")
    )
    return c.raw("events").select("event_id", T.clamp_unit(t.try_cast("double")).alias("confidence"))


@query("first_sentence", f"SELECT doc_id, {S.first_sentence('text')} AS first_sentence FROM documents")
def first_sentence(c: Corpus):
    return c.raw("documents").select("doc_id", T.first_sentence(F.col("text")).alias("first_sentence"))


@query("meta_text_flag", f"SELECT document_id, coalesce({S.meta_text('output')}, false) AS is_meta FROM v_payloads")
def meta_text_flag(c: Corpus):
    return c.payloads.select("document_id", F.coalesce(T.is_meta_text(F.col("output")), F.lit(False)).alias("is_meta"))


@query("program_url_flag", f"SELECT id, canonical_url, {S.program_focused('canonical_url')} AS program_focused FROM v_sources")
def program_url_flag(c: Corpus):
    return c.sources.select("id", "canonical_url", U.is_program_focused_url(F.col("canonical_url")).alias("program_focused"))


@query("normalize_documents", """
SELECT document_id, source_id, payload_type, title, author, source_type, summary, raw_text, n_programs, n_claims,
  parse_confidence, warnings FROM v_normalized""")
def normalize_documents(c: Corpus):
    return N.normalize(c.payloads).select(
        "document_id", "source_id", "payload_type", "title", "author", "source_type", "summary", "raw_text",
        F.size("programs").cast("long").alias("n_programs"), F.size("claims").cast("long").alias("n_claims"),
        "parse_confidence", F.array_join("warnings", ",").alias("warnings"),
    )


@query("normalize_programs", "SELECT * FROM v_norm_programs")
def normalize_programs(c: Corpus):
    return N.program_rows(normalized(c))


@query("normalize_claims", "SELECT * FROM v_norm_claims")
def normalize_claims(c: Corpus):
    return N.claim_rows(normalized(c))


@query("infer_programs", "SELECT document_id, name, days_per_week, specialization, summary, confidence FROM v_inferred")
def infer_programs(c: Corpus):
    rows = N.program_rows(normalized(c)).where("programs_inferred")
    return rows.select("document_id", "name", "days_per_week", "specialization", "summary", "confidence")


@query("parse_confidence", "SELECT document_id, parse_confidence FROM v_normalized")
def parse_confidence(c: Corpus):
    return N.normalize(c.payloads).select("document_id", "parse_confidence")


@query("validation_errors", "SELECT document_id, validation_errors FROM v_normalized")
def validation_errors(c: Corpus):
    return N.normalize(c.payloads).select("document_id", F.array_join("validation_errors", ",").alias("validation_errors"))


@query("extraction_diagnostics", f"""
SELECT n.document_id, n.source_id, payload_type, parse_confidence, coalesce(length({S.strip('raw_text')}), 0) AS raw_text_length,
  n_programs AS programs_in_payload, n_claims AS claims_count, coalesce(p.n, 0) AS programs_in_db, validation_errors, warnings
FROM v_normalized n LEFT JOIN (SELECT document_id, count(*) AS n FROM v_programs GROUP BY 1) p USING (document_id)""")
def extraction_diagnostics(c: Corpus):
    return N.diagnostics(normalized(c), c.programs)


_canonical = "'title', 'author', 'source_type', 'summary', 'main_text', 'programs', 'claims'"


@query("structured_output", f"""
WITH k AS (SELECT *, list_filter(coalesce(json_keys(j), []), lambda x: x NOT IN ({_canonical})) AS own FROM v_normalized)
SELECT document_id, title, author, source_type, summary, raw_text AS main_text, n_programs, n_claims,
  array_to_string(list_sort(list_concat(own, [{_canonical}])), ',') AS keys,
  md5(array_to_string(list_transform(list_sort(own), lambda x: x || '=' || json_extract_string(j, '$.' || x)), '|')) AS rest_md5 FROM k""")
def structured_output(c: Corpus):
    """The merged JSON, read back: its canonical fields, all its keys and the values of the others."""
    made = N.structured_output(N.normalize(c.payloads))
    v = F.col("v")
    back = made.withColumn("v", F.parse_json("structured")).withColumn("m", F.try_variant_get(v, "$", "map<string,variant>"))
    names = F.array_sort(F.map_keys("m"))
    others = F.filter(names, lambda k: ~k.isin("title", "author", "source_type", "summary", "main_text", "programs", "claims"))
    rest = F.transform(others, lambda k: F.concat(k, F.lit("="), F.try_variant_get(F.col("m")[k], "$", "string")))
    texts = [F.try_variant_get(v, f"$.{k}", "string").alias(k) for k in ("title", "author", "source_type", "summary", "main_text")]
    sizes = [F.size(F.try_variant_get(v, f"$.{k}", "array<variant>")).cast("long").alias(f"n_{k}") for k in ("programs", "claims")]
    return back.select(
        "document_id", *texts, *sizes, F.array_join(names, ",").alias("keys"),
        F.md5(F.array_join(rest, "|").cast("binary")).alias("rest_md5"),
    )


@query("link_claims", rf"""
WITH placed AS (SELECT document_id, id AS program_id, lower({S.strip('name')}) AS key,
    row_number() OVER (PARTITION BY document_id ORDER BY id) - 1 AS place, count(*) OVER (PARTITION BY document_id) AS n FROM v_programs),
refs AS (SELECT *, TRY_CAST({S.strip('raw_ref')} AS BIGINT) AS num FROM v_claim_refs)
SELECT r.id, r.document_id, r.raw_ref, CASE
  WHEN num IS NULL THEN (SELECT arg_max(p.program_id, p.place) FROM placed p WHERE p.document_id = r.document_id AND p.key = lower({S.strip('r.raw_ref')}))
  ELSE coalesce((SELECT min(p.program_id) FROM placed p WHERE p.document_id = r.document_id AND p.place = num),
    (SELECT min(p.program_id) FROM placed p WHERE p.document_id = r.document_id AND p.place = num - 1)) END AS program_id
FROM refs r""")
def link_claims(c: Corpus):
    refs = c.claim_refs.select("id", "document_id", "raw_ref")
    return N.link_claims(refs, c.programs.select("id", "document_id", "name")).select("id", "document_id", "raw_ref", "program_id")


@query("resolve_attempts", f"""
WITH a AS (SELECT id // 3 AS job_id, id % 3 AS attempt, error_message AS message, error_type,
    coalesce(error_message IN ('schema_invalid', 'no_programs_on_program_page') OR error_message LIKE 'low_quality%', false) AS invalid FROM v_crawl_jobs),
e AS (SELECT *, message IS NULL OR attempt = 2 OR NOT (invalid OR coalesce(error_type IN ({S.quoted(V.RETRYABLE_ERROR_TYPES)}), false)) AS ends FROM a),
f AS (SELECT job_id, min(attempt) FILTER (WHERE ends) AS last_attempt, max(attempt) AS open_attempt FROM e GROUP BY 1),
g AS (SELECT f.job_id, f.last_attempt IS NULL AS open, coalesce(last_attempt, open_attempt) AS attempt, e.message, e.error_type
  FROM f JOIN e ON e.job_id = f.job_id AND e.attempt = coalesce(last_attempt, open_attempt)),
h AS (SELECT *, CASE WHEN open THEN 'running' WHEN message IS NULL THEN 'succeeded' ELSE 'failed' END AS status,
  CASE WHEN attempt = 0 THEN 'primary' ELSE 'fallback' END AS model FROM g)
SELECT job_id, status, CASE WHEN open THEN attempt + 1 ELSE attempt END AS retry_count, model,
  CASE status WHEN 'failed' THEN 'extract failed after ' || (attempt + 1) || '/3 attempts: ' || message
    WHEN 'running' THEN 'extract attempt ' || (attempt + 1) || '/3 failed (model=' || model || '): ' || message || '; retrying' END AS error_message,
  CASE WHEN status = 'failed' THEN {S.error_code('message', 'error_type')} END AS error_code
FROM h""")
def resolve_attempts(c: Corpus):
    """Every three consecutive crawl jobs are read as the attempts of one job."""
    bad = F.col("error_message")
    invalid = bad.isin("schema_invalid", "no_programs_on_program_page") | bad.startswith("low_quality")
    attempts = c.crawl_jobs.select(
        F.floor(F.col("id") / 3).alias("job_id"), (F.col("id") % 3).alias("attempt"), F.lit("extract").alias("job_type"),
        bad.alias("message"), "error_type",
        F.coalesce(invalid, F.lit(False)).alias("invalid"),
    )
    return N.resolve_attempts(attempts)


@query("raw_html_artifact", f"""
SELECT document_id, source_id, coalesce({payload_views.first_text('j', V.HTML_KEYS)},
  '<html><body><pre>' || replace(replace(replace(replace(replace(coalesce(raw_text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')
  || '</pre></body></html>') AS html FROM v_fields""")
def raw_html_artifact(c: Corpus):
    return N.raw_html(N.fields(N.coerce(c.payloads)))


@query("error_codes", f"""
SELECT id, code, {S.error_kind('code')} AS kind FROM (
  SELECT id, {S.error_code('error_message', 'error_type')} AS code FROM v_crawl_jobs WHERE status = 'failed')""")
def error_codes(c: Corpus):
    from quarrylight.functions import errors as E

    failed = c.crawl_jobs.where("status = 'failed'")
    coded = failed.select("id", E.error_code(F.col("error_message"), F.col("error_type")).alias("code"))
    return coded.select("id", "code", E.error_kind(F.col("code")).alias("kind"))


# -- extraction batches ----------------------------------------------------------
#: New documents are numbered from here.
NEW_IDS = 1_000_000_000
view("v_extracted", f"""
SELECT *, {NEW_IDS} + document_id AS new_id, TIMESTAMP '2024-02-01 00:00:00' + to_minutes(document_id % 3) AS at_time FROM v_normalized WHERE validation_errors = ''""")
view("v_new_programs", f"""
SELECT (e.new_id * {BT.PER_DOCUMENT} + p.pos)::BIGINT AS id, e.new_id AS document_id, p.* EXCLUDE (document_id, source_id, pos, programs_inferred) FROM v_norm_programs p JOIN v_extracted e USING (document_id)""")
view("v_new_claims", f"""
SELECT (e.new_id * {BT.PER_DOCUMENT} + c.pos)::BIGINT AS id, e.new_id AS document_id, c.* EXCLUDE (document_id, pos), TRY_CAST({S.strip('c.raw_ref')} AS BIGINT) AS num
FROM v_norm_claims c JOIN v_extracted e USING (document_id)""")


def extraction_log(c: Corpus) -> BT.BatchLog:
    """All valid extractions in two batches by number, the first of them committed a second time."""
    home = f"{c.home}/stage/extractions-{uuid.uuid4().hex[:12]}"
    log, rows = BT.BatchLog(c.spark, home), normalized(c)
    d = F.col("document_id")
    jobs = rows.select("document_id", (d + NEW_IDS).alias("new_id"), plus_seconds(day("2024-02-01"), (d % 3) * 60).alias("at"))
    for batch, part in (("b0", d % 2 == 0), ("b1", d % 2 == 1), ("b0", d % 2 == 0)):
        log.commit(batch, BT.extraction_tables(rows.where(part), jobs))
    return log


@query("extraction_documents", f"""
SELECT new_id AS id, source_id, document_id AS crawl_job_id, title, summary, md5(raw_text) AS text_md5, parse_confidence,
  'sources/' || source_id || '/crawls/' || document_id || '/extracted.json' AS json_path, {S.iso('at_time')} AS created_at FROM v_extracted""")
def extraction_documents(c: Corpus):
    rows = extraction_log(c).read("documents", "id long, source_id long, crawl_job_id long, title string, summary string, raw_text string, parse_confidence double, json_path string, created_at timestamp")
    return rows.withColumn("text_md5", F.md5(F.col("raw_text").cast("binary"))).drop("raw_text").withColumn("created_at", iso("created_at"))


@query("extraction_programs", "SELECT * FROM v_new_programs")
def extraction_programs(c: Corpus):
    return extraction_log(c).read(
        "programs", "id long, document_id long, name string, coach_name string, days_per_week long, specialization string, experience_level string, "
        "progression_type string, split_type string, summary string, confidence double",
    )


@query("extraction_claims", f"""
WITH placed AS (SELECT document_id, id AS program_id, lower({S.strip('name')}) AS key,
    row_number() OVER (PARTITION BY document_id ORDER BY id) - 1 AS place FROM v_new_programs)
SELECT r.id, r.document_id, CASE
  WHEN num IS NULL THEN (SELECT arg_max(p.program_id, p.place) FROM placed p WHERE p.document_id = r.document_id AND p.key = lower({S.strip('r.raw_ref')}) AND p.key <> '')
  ELSE coalesce((SELECT min(p.program_id) FROM placed p WHERE p.document_id = r.document_id AND p.place = num),
    (SELECT min(p.program_id) FROM placed p WHERE p.document_id = r.document_id AND p.place = num - 1)) END AS program_id,
  r.claim_type, r.raw_text, r.normalized_value, r.confidence FROM v_new_claims r""")
def extraction_claims(c: Corpus):
    return extraction_log(c).read(
        "claims", "id long, document_id long, program_id long, claim_type string, raw_text string, normalized_value string, confidence double"
    )


@query("extraction_sources", f"""
WITH n AS (SELECT * FROM v_extracted QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY at_time DESC, new_id DESC) = 1)
SELECT s.id, s.canonical_url, CASE WHEN n.source_id IS NULL THEN s.title ELSE n.title END AS title, CASE WHEN n.source_id IS NULL THEN s.author ELSE n.author END AS author,
  CASE WHEN n.source_id IS NULL THEN s.source_type ELSE n.source_type END AS source_type, CASE WHEN n.source_id IS NULL THEN s.status ELSE 'succeeded' END AS status,
  {S.iso('CASE WHEN n.source_id IS NULL THEN s.last_crawled_at ELSE n.at_time END')} AS last_crawled_at, CASE WHEN n.source_id IS NULL THEN s.latest_document_id ELSE n.new_id END AS latest_document_id
FROM v_sources s LEFT JOIN n ON n.source_id = s.id""")
def extraction_sources(c: Corpus):
    """Sources with the pointers that the batches made visible together with their documents."""
    states = extraction_log(c).read("states", "source_id long, last_crawled_at timestamp, latest_document_id long, title string, author string, source_type string, status string")
    return BT.current_sources(c.sources, states).withColumn("last_crawled_at", iso("last_crawled_at"))
