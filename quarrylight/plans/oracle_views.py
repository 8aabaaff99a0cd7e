"""The corpus tables once more, as SQL over the raw driver tables.

``with_views(sql)`` puts the views a statement names (and those they name in
turn) in front of it as common table expressions.
"""

from __future__ import annotations

import re

from quarrylight.functions import fixed_values as V
from quarrylight.plans import sqltext as S
from quarrylight.sources import corpus as C

VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql


def with_views(sql: str) -> str:
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(VIEWS[name])

    visit(sql)
    if not needed:
        return sql
    ctes = ",\n".join(f"{n} AS (\n{VIEWS[n]}\n)" for n in VIEWS if n in needed)
    body = sql.strip()
    if re.match(r"(?is)with\s", body):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def clone_views(base: str, replacement: str, suffix: str, roots: list[str]) -> None:
    """Copies of ``roots`` and of what they build on ``base``, over ``replacement``."""
    memo: dict[str, bool] = {}

    def depends(name: str) -> bool:
        if name not in memo:
            memo[name] = name == base or any(
                depends(n) for n in VIEWS if n != name and re.search(rf"\b{n}\b", VIEWS[name])
            )
        return memo[name]

    names = [n for n in VIEWS if n != base and depends(n)]

    def swap(text: str) -> str:
        for n in names:
            text = re.sub(rf"\b{n}\b", n + suffix, text)
        return re.sub(rf"\b{base}\b", replacement, text)

    wanted: list[str] = []

    def visit(name: str) -> None:
        for n in names:
            if n != name and n not in wanted and re.search(rf"\b{n}\b", VIEWS[name]):
                visit(n)
        if name not in wanted:
            wanted.append(name)

    for root in roots:
        visit(root)
    for n in wanted:
        VIEWS[n + suffix] = swap(VIEWS[n])


view("v_candidate_parts", r"""
SELECT page_id,
  regexp_extract(url, '^https?://([^/?#]*)', 1) AS host,
  regexp_extract(url, '^(https?)://', 1) AS head,
  regexp_extract(url, '^https?://[^/?#]*(.*)$', 1) AS tail,
  regexp_replace(regexp_extract(regexp_extract(url, '^https?://[^/?#]*(.*)$', 1), '^([^?#]*)', 1), '/+$', '') AS plain,
  """ + S.pick("page_id % 10", C.SLUGS) + r""" AS slug
FROM pages""")

view("v_candidates", """
SELECT page_id, 0 AS pos, head || '://' || host || '/' || slug || tail AS raw_url FROM v_candidate_parts
UNION ALL
SELECT page_id, 1, head || '://' || upper(host) || '/' || slug || plain || '/?utm=1' FROM v_candidate_parts WHERE page_id % 25 = 0
UNION ALL
SELECT page_id, 2, head || '://' || host || '/files/item-' || page_id || '.PDF?dl=1' FROM v_candidate_parts WHERE page_id % 10 = 3
UNION ALL
SELECT page_id, 3, CASE page_id % 4 WHEN 0 THEN 'mailto:desk@' || host WHEN 1 THEN 'ftp://' || host || '/feed'
  WHEN 2 THEN '  ' || host || '/feed/latest;v=2 ' ELSE 'http://bad host/' || page_id END
FROM v_candidate_parts WHERE page_id % 5 = 4""")

view("v_page_urls", f"""
SELECT page_id, canonical_url, host, regexp_replace(host, '^(?:www|m|blog)\\.', '') AS domain
FROM (SELECT page_id, canonical_url, {S.netloc('canonical_url')} AS host
  FROM (SELECT page_id, {S.canonical('raw_url')} AS canonical_url FROM v_candidates WHERE pos = 0))""")

view("v_domains", """
SELECT min(page_id) AS id, domain, min(page_id) % 5 <> 0 AS allowlisted, min(page_id) % 7 = 0 AS paused,
  CASE WHEN min(page_id) % 3 = 0 THEN 'seeded' END AS notes
FROM v_page_urls GROUP BY domain""")

view("v_page_sources", """
SELECT page_id, min(page_id) OVER (PARTITION BY canonical_url) AS source_id, domain, canonical_url FROM v_page_urls""")

view("v_documents", rf"""
SELECT id, source_id, CASE WHEN id % 13 <> 0 THEN id END AS crawl_job_id,
  CASE WHEN id % 5 <> 0 THEN created_at - to_days(CAST(id % 30 + 1 AS INTEGER)) END AS published_at,
  raw_text, title, summary,
  CASE WHEN id % 17 <> 0 THEN round(0.2::DOUBLE + (CASE WHEN title <> '' THEN 0.15::DOUBLE ELSE 0 END)
    + (CASE WHEN size >= 2000 THEN 0.3::DOUBLE WHEN size >= 500 THEN 0.2::DOUBLE WHEN size >= 120 THEN 0.1::DOUBLE ELSE 0 END)
    + (CASE WHEN summary IS NOT NULL THEN 0.05::DOUBLE ELSE 0 END) + (CASE WHEN id % 3 > 0 THEN 0.2::DOUBLE ELSE 0 END)
    + (CASE WHEN id % 3 > 0 OR id % 4 = 0 THEN 0.05::DOUBLE ELSE 0 END), 6) END AS parse_confidence, created_at
FROM (
  SELECT d.doc_id AS id, s.source_id, d.text AS raw_text, length({S.strip('d.text')}) AS size,
    coalesce(CASE WHEN d.doc_id % 10 = 0 THEN {S.pick('(d.doc_id // 10) % 12', C.TITLE_THEMES)} || ' ' END, '')
      || regexp_replace(regexp_extract(d.text, '^\s*(\S+(?:\s+\S+){{0,5}})', 1), '\s+', ' ', 'g') AS title,
    CASE WHEN d.doc_id % 4 <> 3 THEN {S.first_sentence('d.text')} END AS summary,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(d.doc_id AS INTEGER)) AS created_at
  FROM documents d JOIN v_page_sources s ON s.page_id = (d.doc_id // 4) % (SELECT count(*) FROM pages))""")

view("v_sources", f"""
SELECT b.id, b.canonical_url AS url, b.canonical_url, d.id AS domain_id,
  {S.pick('b.id % 4', ('article', 'program', 'forum', None))} AS source_type,
  CASE WHEN b.status <> 'pending' THEN l.title END AS title,
  CASE WHEN b.id % 3 = 0 THEN 'Coach ' || (b.id % 17) END AS author, b.status,
  CASE WHEN b.status <> 'pending' AND b.id % 11 <> 0
    THEN TIMESTAMP '2024-01-30 00:00:00' - to_days(CAST(b.id % 40 AS INTEGER)) END AS last_crawled_at,
  CASE WHEN b.status <> 'pending' THEN l.latest END AS latest_document_id,
  TIMESTAMP '2023-12-01 00:00:00' + to_minutes(b.id) AS created_at
FROM (SELECT min(page_id) AS id, canonical_url, domain,
    CASE WHEN min(page_id) % 10 < 2 THEN 'pending' WHEN min(page_id) % 10 = 2 THEN 'failed' ELSE 'succeeded' END AS status
  FROM v_page_urls GROUP BY canonical_url, domain) b
JOIN v_domains d ON d.domain = b.domain
LEFT JOIN (SELECT source_id, max(id) AS latest, arg_max(title, id) AS title FROM v_documents GROUP BY source_id) l
  ON l.source_id = b.id""")

view("v_programs", rf"""
SELECT doc * 10 + i AS id, doc AS document_id,
  CASE WHEN k % 10 <> 9 THEN lead || ' ' || (CASE WHEN doc % 6 = 2 THEN 'Builder' ELSE {S.pick('k % 7', C.PROGRAM_THEMES)} END) END AS name,
  CASE WHEN k % 4 = 0 THEN 'Coach ' || (k % 23) END AS coach_name,
  CASE WHEN k % 4 <> 0 THEN 2 + k % 5 END AS days_per_week,
  {S.pick('k % 8', C.SPECIALIZATIONS)} AS specialization, {S.pick('k % 4', C.LEVELS)} AS experience_level,
  {S.pick('k % 6', C.PROGRESSIONS)} AS progression_type, {S.pick('k % 5', C.SPLITS)} AS split_type,
  CASE WHEN k % 6 <> 5 THEN summary END AS summary,
  CASE WHEN k % 9 <> 0 THEN ((doc * 7 + i) % 101) / 100.0::DOUBLE END AS confidence,
  created_at + to_hours(CAST(i AS INTEGER)) AS created_at
FROM (SELECT id AS doc, i, id + i AS k, regexp_extract(title, '^(\S+(?: \S+){{0,2}})', 1) AS lead, summary, created_at
  FROM v_documents, unnest(range(1, id % 3 + 1)) AS t(i))""")

view("v_claim_refs", rf"""
SELECT doc * 10 + pos AS id, doc AS document_id, pos,
  CASE k % 5 WHEN 0 THEN CAST(pos - 1 AS VARCHAR) WHEN 1 THEN CAST(doc % 3 AS VARCHAR)
    WHEN 2 THEN ' ' || lower(lead || ' Builder') || ' ' WHEN 3 THEN '999' END AS raw_ref,
  {S.pick('k % 4', ('volume', 'frequency', 'intensity', None))} AS claim_type,
  CASE WHEN k % 7 <> 0 THEN summary END AS raw_text,
  CASE WHEN k % 3 = 0 THEN (k % 20) || ' sets' END AS normalized_value,
  CASE WHEN k % 8 <> 0 THEN (k % 101) / 100.0::DOUBLE END AS confidence
FROM (SELECT id AS doc, pos, id + pos AS k, regexp_extract(title, '^(\S+(?: \S+){{0,2}})', 1) AS lead, summary
  FROM v_documents, unnest(range(1, id % 3 + (CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END) + 1)) AS t(pos))""")

view("v_crawl_jobs", f"""
SELECT id, CASE WHEN discover THEN 'discover' ELSE 'extract' END AS job_type,
  CASE WHEN NOT discover THEN source_id END AS source_id,
  CASE WHEN discover THEN 'https://' || domain ELSE canonical_url END AS target_url, status, id % 3 AS retry_count,
  CASE WHEN id % 6 <> 0 THEN value / 100 END AS cost, started_at,
  CASE WHEN status IN ('succeeded', 'failed') THEN started_at + to_seconds(id % 600) END AS completed_at,
  CASE WHEN event_type = 'error' THEN {S.pick('id % 18', C.ERROR_MESSAGES)} END AS error_message,
  CASE WHEN event_type = 'error' THEN {S.pick('id % 5', C.ERROR_TYPES)} END AS error_type
FROM (SELECT e.event_id AS id, e.event_type, e.value, s.source_id, s.domain, s.canonical_url, e.event_type = 'signup' AS discover,
    CASE WHEN e.event_type = 'error' THEN 'failed' WHEN e.event_type = 'view' AND e.event_id % 50 = 0 THEN 'running'
      WHEN e.event_type = 'signup' AND e.event_id % 40 = 0 THEN 'pending' ELSE 'succeeded' END AS status,
    CASE WHEN e.event_id % 97 <> 0 THEN e.ts END AS started_at
  FROM events e JOIN v_page_sources s ON s.page_id = (e.event_id // 40) % (SELECT count(*) FROM pages))""")

view("v_request_texts", f"""
SELECT item_id AS q, text FROM benchmark
UNION ALL SELECT {C.TURN_IDS} + conv_id * {C.TURNS} + turn, text FROM conversations WHERE role = 'user'""")
view("v_asked", rf"""
SELECT q AS query_id, CASE WHEN q >= {C.BLANK_IDS} THEN '' ELSE trim(coalesce(text, '') || ' ' || {S.pick('q % 19', C.HINTS)}) END AS query,
  CASE WHEN q % 12 = 8 THEN 2 + q % 5 END AS days_per_week,
  CASE WHEN q % 24 = 10 THEN 'strength' END AS specialization,
  CASE WHEN q % 24 = 14 THEN 'beginner' END AS experience_level,
  CASE WHEN q % 48 = 18 THEN 'linear' END AS progression_type,
  CASE WHEN q % 48 = 22 THEN 'full-body' END AS split_type, u.domain,
  CAST({S.pick('q % 4', ('8', '4', '1', '12'))} AS BIGINT) AS max_sources,
  CAST({S.pick('q % 3', ('20', '5', '25'))} AS BIGINT) AS max_programs,
  CAST({S.pick('q % 5', ('8', '3', '8', '25', '1'))} AS BIGINT) AS max_evidence
FROM (SELECT * FROM v_request_texts UNION ALL SELECT q + {C.BLANK_IDS}, NULL FROM v_request_texts WHERE q % 29 = 0) r
LEFT JOIN v_page_urls u ON r.q % 4 = 1 AND u.page_id = r.q % 50""")
view("v_requests", f"SELECT * FROM v_asked WHERE length(query) <= {C.MAX_QUERY}")

view("v_grades", """
SELECT doc_id AS document_id, CASE WHEN quality = 1 AND toxic <> 1 THEN 3 WHEN quality = 1 THEN 2
  WHEN toxic <> 1 THEN 1 ELSE 0 END AS relevance FROM labels""")
