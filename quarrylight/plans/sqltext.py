"""DuckDB expressions used by the SQL twins."""

from __future__ import annotations

from quarrylight.functions import fixed_values as V

_PARTS = r"^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)"


def quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def pick(index: str, values) -> str:
    items = ", ".join("NULL" if v is None else "'" + str(v).replace("'", "''") + "'" for v in values)
    return f"([{items}])[CAST(({index}) + 1 AS INTEGER)]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


def rstrip(x: str) -> str:
    return f"regexp_replace({x}, '[\\s\\p{{Z}}]+$', '')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '[\\s\\p{{Z}}]+', ' ', 'g'))"


def scheme(u: str) -> str:
    return f"lower(regexp_extract({u}, '{_PARTS}', 1))"


def netloc(u: str) -> str:
    return f"lower(regexp_extract({u}, '{_PARTS}', 2))"


def path(u: str) -> str:
    return f"regexp_replace(regexp_extract({u}, '{_PARTS}', 3), ';[^/]*$', '')"


def with_scheme(u: str) -> str:
    s = strip(u)
    return (
        f"(CASE WHEN {netloc(s)} = '' AND {path(s)} <> '' AND NOT contains({s}, '://') "
        f"THEN 'https://' || {s} ELSE {s} END)"
    )


def canonical(u: str) -> str:
    f = with_scheme(u)
    p = path(f)
    return (
        f"((CASE WHEN {scheme(f)} = '' THEN 'https' ELSE {scheme(f)} END) || '://' || {netloc(f)} || "
        f"(CASE WHEN {p} = '' THEN '/' WHEN {p} = '/' THEN '/' ELSE "
        f"(CASE WHEN starts_with({p}, '/') THEN '' ELSE '/' END) || regexp_replace({p}, '/$', '') END))"
    )


def safe_canonical(u: str) -> str:
    f = with_scheme(u)
    return (
        f"(CASE WHEN {scheme(strip(u))} IN ('', 'http', 'https') AND {netloc(f)} <> '' "
        f"AND NOT contains({netloc(f)}, ' ') THEN {canonical(u)} END)"
    )


def allowed_url(u: str) -> str:
    low = f"lower({path(u)})"
    tokens = "|".join("".join(c if c.isalnum() else "\\" + c for c in t) for t in V.BLOCKED_PATH_TOKENS)
    return (
        f"(NOT (regexp_extract(regexp_replace({low}, '/+$', ''), '[^/](\\.[^./]+)$', 1) IN ({quoted(V.ASSET_SUFFIXES)})) "
        f"AND NOT regexp_matches({low}, '/(?:{tokens})(?:/|$)'))"
    )


def page_quality(u: str) -> str:
    down = " ".join(f"- (CASE WHEN {u} ILIKE '%{p}%' THEN 1 ELSE 0 END)" for p in V.LISTING_URL_PARTS)
    up = " ".join(f"+ (CASE WHEN {u} ILIKE '%{p}%' THEN 1 ELSE 0 END)" for p in V.DETAIL_URL_PARTS)
    return f"(0 {down} {up})"


def program_focused(u: str) -> str:
    return "(" + " OR ".join(f"contains(lower({u}), '{p}')" for p in V.PROGRAM_URL_PARTS) + ")"


def short_text(x: str, limit: int = V.SHORT_TEXT_LIMIT) -> str:
    return f"nullif(rtrim(substring({collapse(x)}, 1, {limit})), '')"


def first_sentence(x: str, limit: int = V.SENTENCE_LIMIT) -> str:
    s = strip(x)
    cut = f"regexp_extract({s}, '(?s)^(.*?[.!?])[\\s\\p{{Z}}]', 1)"
    sent = f"(CASE WHEN {cut} <> '' THEN {cut} ELSE {s} END)"
    return (
        f"(CASE WHEN {s} = '' THEN NULL WHEN length({sent}) > {limit} "
        f"THEN {rstrip(f'substring({sent}, 1, {limit})')} || '...' ELSE {sent} END)"
    )


def enum_label(x: str, table) -> str:
    cases = " ".join(f"WHEN contains(lower({x}), '{k}') THEN '{v}'" for k, v in table)
    return f"(CASE {cases} END)"


def days_from_text(x: str) -> str:
    n = f"TRY_CAST(regexp_extract({x}, '\\b(\\d{{1,2}})\\b', 1) AS BIGINT)"
    return f"(CASE WHEN {n} BETWEEN 1 AND 14 THEN {n} END)"


def meta_text(x: str) -> str:
    return "(" + " OR ".join(
        f"contains(lower(substring({x}, 1, {V.META_SAMPLE})), '{p}')" for p in V.META_TEXT_PHRASES
    ) + ")"


def bounded(x: str, limit: int) -> str:
    head = f"substring({x}, 1, {limit})"
    return (
        f"(CASE WHEN length({x}) <= {limit} THEN {x} WHEN contains({head}, ' ') "
        f"THEN regexp_extract({head}, '(?s)^(.*) ', 1) || ' …' ELSE {head} || ' …' END)"
    )


def lines(fields) -> str:
    parts = ", ".join(
        f"CASE WHEN CAST({v} AS VARCHAR) <> '' THEN '{k}: ' || CAST({v} AS VARCHAR) END" for k, v in fields
    )
    return f"concat_ws(chr(10), {parts})"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


def stem(t: str) -> str:
    return (
        f"(CASE WHEN {t} LIKE '%ies' AND {t} NOT LIKE '%eies' AND {t} NOT LIKE '%aies' "
        f"THEN substring({t}, 1, length({t}) - 3) || 'y' "
        f"WHEN {t} LIKE '%es' AND {t} NOT LIKE '%aes' AND {t} NOT LIKE '%ees' AND {t} NOT LIKE '%oes' "
        f"THEN substring({t}, 1, length({t}) - 1) "
        f"WHEN {t} LIKE '%s' AND {t} NOT LIKE '%us' AND {t} NOT LIKE '%ss' "
        f"THEN substring({t}, 1, length({t}) - 1) ELSE {t} END)"
    )


STOP = quoted(V.STOP_WORDS)


def snippet(text: str, query: str, size: int = V.SNIPPET_CHARS, lead: int = V.SNIPPET_LEAD) -> str:
    flat = collapse(text)
    low = f"lower({flat})"
    hits = (
        f"list_filter(list_transform(list_filter({tokens(query)}, lambda t: length(t) > 2), "
        f"lambda t: instr({low}, t)), lambda i: i > 0)"
    )
    first = f"list_min({hits})"
    start = f"greatest(0, {first} - 1 - {lead})"
    end = f"least(length({flat}), {start} + {size})"
    return (
        f"(CASE WHEN {flat} = '' THEN NULL WHEN {first} IS NULL THEN substring({flat}, 1, {size}) || "
        f"(CASE WHEN length({flat}) > {size} THEN '...' ELSE '' END) ELSE "
        f"(CASE WHEN {start} > 0 THEN '...' ELSE '' END) || trim(substring({flat}, {start} + 1, {end} - ({start}))) || "
        f"(CASE WHEN {end} < length({flat}) THEN '...' ELSE '' END) END)"
    )


def iso(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S.%f')"


def error_code(message: str, kind: str) -> str:
    low = f"lower(coalesce({message}, ''))"
    cases = []
    for code, fragments in V.ERROR_RULES:
        cond = " OR ".join(f"contains({low}, '{f}')" for f in fragments)
        if code == "timeout":
            cond += f" OR coalesce({kind}, '') IN ({quoted(V.TIMEOUT_ERROR_TYPES)})"
        cases.append(f"WHEN {cond} THEN '{code}'")
    return (
        f"(CASE {' '.join(cases)} WHEN coalesce({kind}, '') IN ({quoted(V.RETRYABLE_ERROR_TYPES)}) "
        f"THEN 'retryable_browser_use' ELSE 'terminal_error' END)"
    )


def error_kind(code: str) -> str:
    return (
        f"(CASE WHEN coalesce({code}, '') = '' THEN NULL WHEN starts_with({code}, 'blocked_') THEN 'blocked' "
        f"WHEN {code} IN ({quoted(V.RETRYABLE_CODES)}) THEN 'retryable' ELSE 'terminal' END)"
    )
