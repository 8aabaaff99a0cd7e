"""SQL views of the payload table and its normalization."""

from __future__ import annotations

from quarrylight.functions import fixed_values as V
from quarrylight.plans import sqltext as S
from quarrylight.plans.oracle_views import view
from quarrylight.sources import corpus as C


def _filled(template: str) -> str:
    lit = "'" + template.replace("'", "''") + "'"
    return f"replace(replace({lit}, '#', CAST(doc AS VARCHAR)), '@', body)"


view("v_payloads", f"""
SELECT doc AS document_id, source_id, url, CASE
  WHEN doc % 12 = 6 THEN '"' || replace({_filled(C.PAYLOAD_OBJECT_BARE)}, '"', '\\"') || '"'
  WHEN doc % 6 = 0 AND doc % 3 = 0 THEN {_filled(C.PAYLOAD_OBJECT_BARE)}
  WHEN doc % 12 = 1 THEN {_filled(C.PAYLOAD_ALIASES)}
  WHEN doc % 12 = 7 THEN {_filled(C.PAYLOAD_ALIASES_BARE)}
  WHEN doc % 6 = 2 THEN 'Here it is' || chr(10) || '```json' || chr(10) || {_filled(C.PAYLOAD_OBJECT)} || chr(10) || '```' || chr(10) || 'Done'
  WHEN doc % 6 = 3 THEN '[' || {_filled(C.PAYLOAD_OBJECT)} || ']'
  WHEN doc % 30 = 4 THEN '42' WHEN doc % 30 = 10 THEN 'true' WHEN doc % 30 = 16 THEN 'null'
  WHEN doc % 90 = 22 THEN '1.5' WHEN doc % 90 = 52 THEN NULL
  WHEN doc % 6 = 4 THEN body
  ELSE {_filled(C.PAYLOAD_ODD)} END AS output
FROM (SELECT d.id AS doc, d.source_id, s.url, CASE WHEN d.id % 11 = 0 THEN 'Short.'
    WHEN d.id % 7 = 0 THEN 'Summary: ' || regexp_replace(d.raw_text, '[^A-Za-z0-9 .]', ' ', 'g')
    ELSE regexp_replace(d.raw_text, '[^A-Za-z0-9 .]', ' ', 'g') END AS body
  FROM v_documents d JOIN v_sources s ON s.id = d.source_id)""")

view("v_coerced", f"""
SELECT *, CASE WHEN j IS NOT NULL THEN 'object' WHEN own IS NOT NULL THEN 'string'
    WHEN output IS NULL OR k = 'NULL' THEN 'NoneType' WHEN k = 'ARRAY' THEN 'list'
    WHEN k IN ('UBIGINT', 'BIGINT') THEN 'int' WHEN k = 'BOOLEAN' THEN 'bool' ELSE 'float' END AS payload_type
FROM (SELECT *, CASE WHEN k = 'OBJECT' THEN v WHEN json_type(inner_v) = 'OBJECT' THEN inner_v
      WHEN inner_v IS NULL AND json_type(fence_v) = 'OBJECT' THEN fence_v END AS j
  FROM (SELECT *, TRY_CAST({S.strip('own')} AS JSON) AS inner_v,
      TRY_CAST(nullif(regexp_extract({S.strip('own')}, '(?is)```(?:json)?\\s*(\\{{.*?\\}}|\\[.*?\\])\\s*```', 1), '') AS JSON) AS fence_v
    FROM (SELECT *, CASE WHEN v IS NULL THEN output WHEN k = 'VARCHAR' THEN json_extract_string(v, '$') END AS own
      FROM (SELECT *, json_type(v) AS k FROM (SELECT *, TRY_CAST(output AS JSON) AS v FROM v_payloads)))))""")


def first_text(j: str, keys) -> str:
    parts = ", ".join(
        f"CASE WHEN json_type({j}, '$.{k}') = 'VARCHAR' AND regexp_matches(json_extract_string({j}, '$.{k}'), '[^\\s\\p{{Z}}]') "
        f"THEN json_extract_string({j}, '$.{k}') END" for k in keys
    )
    return f"coalesce({parts})"


def clamp(x: str) -> str:
    return f"(CASE WHEN {x} IS NULL OR isnan({x}) THEN NULL WHEN {x} < 0 THEN 0.0::DOUBLE WHEN {x} > 1 THEN 1.0::DOUBLE ELSE {x} END)"


def _number(j: str, key: str) -> str:
    t = f"json_type({j}, '$.{key}')"
    s = f"json_extract_string({j}, '$.{key}')"
    return (
        f"(CASE WHEN {t} = 'BOOLEAN' THEN (CASE WHEN {s} = 'true' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) "
        f"WHEN {t} IN ('VARCHAR', 'BIGINT', 'UBIGINT', 'DOUBLE') THEN TRY_CAST({S.strip(s)} AS DOUBLE) END)"
    )


def days(j: str, key: str) -> str:
    t = f"json_type({j}, '$.{key}')"
    s = f"json_extract_string({j}, '$.{key}')"
    return (
        f"(CASE WHEN {t} IN ('BIGINT', 'UBIGINT') AND TRY_CAST({s} AS BIGINT) BETWEEN 1 AND 14 THEN TRY_CAST({s} AS BIGINT) "
        f"WHEN {t} = 'BOOLEAN' AND {s} = 'true' THEN 1 WHEN {t} = 'VARCHAR' THEN {S.days_from_text(s)} END)"
    )


view("v_fields", f"""
SELECT document_id, source_id, url, j, payload_type, {first_text('j', V.TITLE_KEYS)} AS title,
  {first_text('j', V.AUTHOR_KEYS)} AS author, {S.short_text(first_text('j', V.SOURCE_TYPE_KEYS))} AS source_type,
  {first_text('j', V.SUMMARY_KEYS)} AS summary,
  coalesce({first_text('j', V.TEXT_KEYS)}, CASE WHEN payload_type = 'string' THEN nullif(own, '') END) AS raw_text
FROM v_coerced""")

view("v_found_programs", f"""
SELECT document_id, source_id, row_number() OVER (PARTITION BY document_id ORDER BY at_pos) - 1 AS pos,
  name, coach_name, days_per_week, specialization, experience_level, progression_type, split_type, summary, confidence
FROM (SELECT document_id, source_id, at_pos, {first_text('p', V.PROGRAM_NAME_KEYS)} AS name,
    {first_text('p', V.PROGRAM_COACH_KEYS)} AS coach_name, {days('p', 'days_per_week')} AS days_per_week,
    {S.enum_label(first_text('p', V.SPECIALIZATION_KEYS), V.SPECIALIZATION)} AS specialization,
    {S.enum_label(first_text('p', V.EXPERIENCE_KEYS), V.EXPERIENCE_LEVEL)} AS experience_level,
    {S.enum_label(first_text('p', V.PROGRESSION_KEYS), V.PROGRESSION_TYPE)} AS progression_type,
    {S.enum_label(first_text('p', V.SPLIT_KEYS), V.SPLIT_TYPE)} AS split_type,
    {first_text('p', V.PROGRAM_SUMMARY_KEYS)} AS summary, {clamp(_number('p', 'confidence'))} AS confidence
  FROM (SELECT document_id, source_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS at_pos
    FROM (SELECT document_id, source_id, json_extract(j, '$.programs[*]') AS ps FROM v_fields WHERE json_type(j, '$.programs') = 'ARRAY'))
  WHERE json_type(p) = 'OBJECT')
WHERE coalesce(name, coach_name, CAST(days_per_week AS VARCHAR), specialization, experience_level, progression_type, split_type, summary) IS NOT NULL""")

view("v_inferred", f"""
SELECT document_id, source_id, 0::BIGINT AS pos, {S.strip('title')} AS name, NULL::VARCHAR AS coach_name,
  {S.days_from_text('raw_text')} AS days_per_week, {S.enum_label('title', V.SPECIALIZATION)} AS specialization,
  NULL::VARCHAR AS experience_level, NULL::VARCHAR AS progression_type, NULL::VARCHAR AS split_type,
  coalesce(nullif({S.strip('summary')}, ''), {S.first_sentence('raw_text')}) AS summary, 0.35::DOUBLE AS confidence
FROM v_fields WHERE {S.program_focused('url')} AND title IS NOT NULL
  AND document_id NOT IN (SELECT document_id FROM v_found_programs)""")

view("v_norm_programs", """
SELECT *, false AS programs_inferred FROM v_found_programs UNION ALL SELECT *, true FROM v_inferred""")

view("v_norm_claims", f"""
SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY at_pos) - 1 AS pos, raw_ref,
  {S.short_text('ctype')} AS claim_type, raw_text, normalized_value, confidence
FROM (SELECT document_id, at_pos,
    CASE json_type(p, '$.program_id') WHEN 'BOOLEAN' THEN (CASE WHEN json_extract_string(p, '$.program_id') = 'true' THEN '1' ELSE '0' END)
      WHEN 'NULL' THEN NULL WHEN 'OBJECT' THEN NULL WHEN 'ARRAY' THEN NULL ELSE json_extract_string(p, '$.program_id') END AS raw_ref,
    {first_text('p', V.CLAIM_TYPE_KEYS)} AS ctype, {first_text('p', V.CLAIM_TEXT_KEYS)} AS raw_text,
    {first_text('p', V.CLAIM_VALUE_KEYS)} AS normalized_value, {clamp(_number('p', 'confidence'))} AS confidence
  FROM (SELECT document_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS at_pos
    FROM (SELECT document_id, json_extract(j, '$.claims[*]') AS ps FROM v_fields WHERE json_type(j, '$.claims') = 'ARRAY'))
  WHERE json_type(p) = 'OBJECT')
WHERE coalesce(ctype, raw_text, normalized_value) IS NOT NULL""")

view("v_normalized", f"""
SELECT f.*, coalesce(p.n, 0) AS n_programs, coalesce(p.inferred, false) AS programs_inferred, coalesce(c.n, 0) AS n_claims,
  round({clamp(f'''(0.2::DOUBLE + (CASE WHEN title IS NOT NULL THEN 0.15::DOUBLE ELSE 0 END)
    + (CASE WHEN coalesce(length({S.strip('raw_text')}), 0) >= 2000 THEN 0.3::DOUBLE WHEN coalesce(length({S.strip('raw_text')}), 0) >= 500 THEN 0.2::DOUBLE
       WHEN coalesce(length({S.strip('raw_text')}), 0) >= 120 THEN 0.1::DOUBLE ELSE 0 END)
    + (CASE WHEN summary IS NOT NULL THEN 0.05::DOUBLE ELSE 0 END) + (CASE WHEN coalesce(p.n, 0) > 0 THEN 0.2::DOUBLE ELSE 0 END)
    + (CASE WHEN coalesce(c.n, 0) > 0 THEN 0.05::DOUBLE ELSE 0 END) - (CASE WHEN payload_type <> 'object' THEN 0.25::DOUBLE ELSE 0 END)
    - (CASE WHEN coalesce(p.inferred, false) THEN 0.1::DOUBLE ELSE 0 END))''')}, 6) AS parse_confidence,
  concat_ws(',', CASE WHEN payload_type <> 'object' THEN 'schema_invalid' END, CASE WHEN coalesce(p.inferred, false) THEN 'programs_inferred' END) AS warnings,
  CASE WHEN payload_type <> 'object' THEN 'schema_invalid' ELSE concat_ws(',',
    CASE WHEN length(coalesce({S.strip('raw_text')}, '')) < 80 OR {S.meta_text(S.strip('raw_text'))} THEN 'low_quality_output' END,
    CASE WHEN {S.program_focused('url')} AND coalesce(p.n, 0) = 0 THEN 'no_programs_on_program_page' END) END AS validation_errors
FROM v_fields f
LEFT JOIN (SELECT document_id, count(*) AS n, bool_or(programs_inferred) AS inferred FROM v_norm_programs GROUP BY 1) p USING (document_id)
LEFT JOIN (SELECT document_id, count(*) AS n FROM v_norm_claims GROUP BY 1) c USING (document_id)""")
