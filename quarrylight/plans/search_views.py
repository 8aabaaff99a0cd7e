"""SQL views of the index and of both retrieval legs."""

from __future__ import annotations

from quarrylight.functions import fixed_values as V
from quarrylight.plans import sqltext as S
from quarrylight.plans.oracle_views import view

_FILTERS = ("days_per_week", "specialization", "experience_level", "progression_type", "split_type")


def lexeme_list(text: str) -> str:
    """Distinct stems of the non-stop tokens (order not kept)."""
    return (
        f"list_distinct(list_transform(list_filter({S.tokens(text)}, lambda t: t NOT IN ({S.STOP})), "
        f"lambda t: {S.stem('t')}))"
    )


view("v_content", """
SELECT id AS doc_id, concat_ws(chr(10), nullif(title, ''), nullif(summary, ''), nullif(raw_text, '')) AS content FROM v_documents""")

view("v_tokens", f"""
SELECT doc_id, pos, {S.stem('token')} AS lexeme FROM (
  SELECT doc_id, unnest(ts) AS token, generate_subscripts(ts, 1) AS pos
  FROM (SELECT doc_id, {S.tokens('content')} AS ts FROM v_content)) WHERE token NOT IN ({S.STOP})""")

view("v_tf", "SELECT doc_id, lexeme, count(*) AS tf FROM v_tokens GROUP BY ALL")

view("v_qlex", f"""
SELECT query_id, unnest(ls) AS lexeme, len(ls) AS n_lexemes
FROM (SELECT query_id, {lexeme_list('query')} AS ls FROM v_requests)""")

_phrases = ", ".join(
    f"({i}, '{p}', [{S.quoted(ts)}])" for i, (p, ts) in enumerate(V.PHRASE_EXPANSIONS)
)
_tokens = ", ".join(f"('{t}', [{S.quoted(ts)}])" for t, ts in V.TOKEN_EXPANSIONS)
_rest = (
    f"list_reduce(list_prepend(norm, list_filter([{S.quoted(p for p, _ in V.PHRASE_EXPANSIONS)}], "
    "lambda p: contains(norm, p))), lambda acc, p: replace(acc, p, ' '))"
)

view("v_norm", f"""
SELECT query_id, query, {S.strip("replace(lower(query), '–', '-')")} AS norm FROM v_requests""")

view("v_terms", f"""
SELECT query_id, term, min(pos) AS pos FROM (
  SELECT n.query_id, unnest(p.terms) AS term, p.i * 1000 + generate_subscripts(p.terms, 1) AS pos
  FROM v_norm n JOIN (VALUES {_phrases}) p(i, phrase, terms) ON contains(n.norm, p.phrase)
  UNION ALL
  SELECT query_id, unnest(ts), 100000 + at_pos * 1000 + generate_subscripts(ts, 1) FROM (
    SELECT r.query_id, r.at_pos, coalesce(t.terms, [r.token]) AS ts FROM (
      SELECT query_id, unnest(tk) AS token, generate_subscripts(tk, 1) AS at_pos
      FROM (SELECT query_id, {S.tokens(_rest)} AS tk FROM v_norm)) r
    LEFT JOIN (VALUES {_tokens}) t(token, terms) ON t.token = r.token))
GROUP BY query_id, term""")

view("v_intent", """
SELECT query_id, query, CASE
    WHEN regexp_matches(norm, '\\b[2-6]\\s*-?\\s*days?\\b') THEN CAST(regexp_extract(norm, '\\b([2-6])\\s*-?\\s*days?\\b', 1) AS BIGINT)
    """ + " ".join(
    f"WHEN regexp_matches(norm, '\\b{w}\\s*-?\\s*days?\\b') THEN {n}" for w, n in V.DAY_WORDS
) + """ END AS intent_days,
  CASE WHEN contains(norm, 'post novice') OR contains(norm, 'intermediate') THEN 'intermediate'
    WHEN contains(norm, 'novice') OR contains(norm, 'beginner') OR contains(norm, 'first meet') THEN 'beginner'
    WHEN contains(norm, 'advanced') THEN 'advanced' END AS intent_experience,
  CASE WHEN contains(norm, 'full body') THEN 'full-body' WHEN contains(norm, 'upper lower') THEN 'upper-lower' END AS intent_split
FROM v_norm""")

view("v_groups", f"""
SELECT query_id, g, unnest(ls) AS lexeme, len(ls) AS size FROM (
  SELECT query_id, pos AS g, {lexeme_list('term')} AS ls FROM (
    SELECT query_id, term, pos FROM v_terms
    UNION ALL SELECT query_id, '{V.EMPTY_EXPANSION_QUERY}', 0 FROM v_requests
      WHERE query_id NOT IN (SELECT query_id FROM v_terms)))
WHERE query_id IN (SELECT query_id FROM v_requests WHERE query <> '')""")

_weight = (
    "list_sum(list_transform(range(1, least(tf, 255) + 1), lambda j: 1.0::DOUBLE / (j * j))) * 0.1::DOUBLE / 1.64493406685::DOUBLE"
)

view("v_weights", f"""
SELECT doc_id, lexeme, tf, {_weight} AS w FROM v_tf
WHERE lexeme IN (SELECT lexeme FROM v_qlex UNION SELECT lexeme FROM v_groups)""")

view("v_exact_matches", """
SELECT q.query_id, w.doc_id, round(sum(w.w) / max(q.n_lexemes), 6) AS text_rank
FROM v_qlex q JOIN v_weights w USING (lexeme) GROUP BY q.query_id, w.doc_id HAVING count(*) = max(q.n_lexemes)""")

view("v_expanded_matches", """
SELECT m.query_id, m.doc_id, round(sum(w.w) / max(l.n), 6) AS text_rank
FROM (SELECT DISTINCT query_id, doc_id FROM (
    SELECT g.query_id, w.doc_id, g.g FROM v_groups g JOIN v_weights w USING (lexeme)
    GROUP BY g.query_id, w.doc_id, g.g HAVING count(*) = max(g.size))) m
JOIN (SELECT query_id, unnest(ls) AS lexeme, len(ls) AS n
  FROM (SELECT query_id, list(DISTINCT lexeme) AS ls FROM v_groups GROUP BY query_id)) l USING (query_id)
JOIN v_weights w ON w.doc_id = m.doc_id AND w.lexeme = l.lexeme
GROUP BY m.query_id, m.doc_id""")

view("v_shelf_sources", f"""
SELECT s.id AS source_id, s.canonical_url, d.domain AS source_domain, {S.page_quality('s.canonical_url')} AS page_quality
FROM v_sources s JOIN v_domains d ON d.id = s.domain_id""")

view("v_shelf_programs", """
SELECT p.id AS program_id, p.document_id AS doc_id, d.source_id, p.confidence, p.days_per_week AS p_days_per_week,
  p.specialization AS p_specialization, p.experience_level AS p_experience_level, p.progression_type AS p_progression_type,
  p.split_type AS p_split_type, s.canonical_url, s.source_domain, s.page_quality,
  coalesce(j.started_at, d.created_at, p.created_at) AS newest_crawl
FROM v_programs p JOIN v_documents d ON d.id = p.document_id JOIN v_shelf_sources s ON s.source_id = d.source_id
LEFT JOIN v_crawl_jobs j ON j.id = d.crawl_job_id""")

_pass = " AND ".join(f"(r.{f} IS NULL OR r.{f} = p.p_{f})" for f in _FILTERS) + (
    " AND (r.domain IS NULL OR r.domain = p.source_domain)"
)
_score = " + ".join(f"(CASE WHEN r.{f} IS NOT NULL THEN 1 ELSE 0 END)" for f in (*_FILTERS, "domain"))

def _define_legs(prefix: str, condition: str, score: str) -> None:
    """Both legs for one way of applying the filters of a request."""
    view(f"{prefix}exact_programs", f"""
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY structured_score DESC, text_rank DESC, page_quality DESC,
  confidence DESC NULLS LAST, newest_crawl DESC NULLS LAST, program_id ASC) AS rank
FROM (SELECT r.query_id, m.text_rank, {score} AS structured_score, p.*
  FROM v_requests r JOIN v_exact_matches m USING (query_id) JOIN v_shelf_programs p USING (doc_id) WHERE {condition}
  UNION ALL
  SELECT r.query_id, 0.0::DOUBLE, {score}, p.* FROM v_requests r JOIN v_shelf_programs p ON {condition} WHERE r.query = '')""")
    view(f"{prefix}expanded_programs", f"""
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY intent_score DESC, text_rank DESC,
  confidence DESC NULLS LAST, program_id ASC) AS rank
FROM (SELECT r.query_id, m.text_rank, p.*,
    (CASE WHEN p.p_days_per_week = i.intent_days THEN 3 ELSE 0 END)
    + (CASE WHEN p.p_experience_level = i.intent_experience THEN 3 ELSE 0 END)
    + (CASE WHEN p.p_split_type = i.intent_split THEN 2 ELSE 0 END) AS intent_score
  FROM v_requests r JOIN v_intent i USING (query_id) JOIN v_expanded_matches m USING (query_id)
  JOIN v_shelf_programs p USING (doc_id) WHERE {condition})""")


_define_legs("v_", _pass, _score)
_define_legs("v_plain_", "true", "0")


def program_search_sql(limit: int, prefix: str = "v_") -> str:
    """A subquery with the filled program ranking of every request."""
    return f"""(
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY leg_no, rank) AS rank, leg, program_id, doc_id, source_id, text_rank, confidence
FROM (
  SELECT query_id, rank, 'exact' AS leg, 0 AS leg_no, program_id, doc_id, source_id, text_rank, confidence
  FROM {prefix}exact_programs WHERE rank <= {limit}
  UNION ALL
  SELECT query_id, rank, 'expanded', 1, program_id, doc_id, source_id, text_rank, confidence
  FROM {prefix}expanded_programs e WHERE rank <= {max(2 * limit, 25)}
    AND NOT EXISTS (SELECT 1 FROM {prefix}exact_programs x WHERE x.query_id = e.query_id AND x.program_id = e.program_id AND x.rank <= {limit}))
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY leg_no, rank) <= {limit})"""


_SOURCE_RANKS = """
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY text_rank DESC, page_quality DESC,
  latest_document_at DESC NULLS LAST, source_id ASC) AS rank
FROM (SELECT r.query_id, s.source_id, m.text_rank, s.page_quality, m.latest_document_at
  FROM (SELECT x.query_id, d.source_id, max(x.text_rank) AS text_rank, max(d.created_at) AS latest_document_at
    FROM v_exact_matches x JOIN v_documents d ON d.id = x.doc_id GROUP BY 1, 2
    UNION ALL SELECT r.query_id, d.source_id, 0.0::DOUBLE, max(d.created_at)
    FROM v_requests r, v_documents d WHERE r.query = '' GROUP BY 1, 2) m
  JOIN v_requests r USING (query_id) JOIN v_shelf_sources s USING (source_id)
  WHERE {condition})"""
view("v_source_ranks", _SOURCE_RANKS.format(condition="r.domain IS NULL OR r.domain = s.source_domain"))
view("v_plain_source_ranks", _SOURCE_RANKS.format(condition="true"))
