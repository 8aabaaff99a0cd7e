"""Index and retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.functions import urls as U
from quarrylight.operators import index as IX
from quarrylight.operators import retrieve as R
from quarrylight.plans import sqltext as S
from quarrylight.plans.catalog_views import iso
from quarrylight.plans.registry import query
from quarrylight.operators.stems import stems_sql
from quarrylight.plans.oracle_views import view
from quarrylight.plans.search_views import _weight, lexeme_list, program_search_sql
from quarrylight.sources.corpus import Corpus


@query("content_text", "SELECT doc_id, content FROM v_content")
def content_text(c: Corpus):
    return IX.content(c.document_bodies)


@query("postings", """
SELECT doc_id, lexeme, count(*) AS tf, string_agg(CAST(pos AS VARCHAR), ' ' ORDER BY pos) AS positions
FROM v_tokens GROUP BY doc_id, lexeme""")
def postings(c: Corpus):
    return IX.postings(IX.content(c.document_bodies), IX.repeated_ids(c)).withColumn(
        "positions", F.array_join(F.col("positions").cast("array<string>"), " ")
    )


@query("query_lexemes", f"""
SELECT query_id, query, len({lexeme_list('query')}) AS n_lexemes,
  array_to_string(list_sort({lexeme_list('query')}), ' ') AS lexemes FROM v_requests""")
def query_lexemes(c: Corpus):
    ls = T.lexemes(F.col("query"))
    return c.requests.select(
        "query_id", "query", F.size(ls).cast("long").alias("n_lexemes"),
        F.array_join(F.array_sort(ls), " ").alias("lexemes"),
    )


@query("query_expansion", """
SELECT r.query_id, r.query, coalesce(string_agg(t.term, '|' ORDER BY t.pos), '') AS terms, count(t.term) AS n_terms
FROM v_requests r LEFT JOIN v_terms t USING (query_id) GROUP BY r.query_id, r.query""")
def query_expansion(c: Corpus):
    e = R.expand_requests(c.requests)
    return e.select(
        "query_id", "query", F.array_join("terms", "|").alias("terms"), F.size("terms").cast("long").alias("n_terms")
    )


@query("query_intent", "SELECT query_id, intent_days, intent_experience, intent_split FROM v_intent")
def query_intent(c: Corpus):
    return R.expand_requests(c.requests).select(
        "query_id", F.col("intent_days").cast("long").alias("intent_days"), "intent_experience", "intent_split"
    )


@query("text_rank", """
SELECT query_id, 'exact' AS leg, doc_id, text_rank FROM v_exact_matches
UNION ALL SELECT query_id, 'expanded', doc_id, text_rank FROM v_expanded_matches""")
def text_rank(c: Corpus):
    return R.match_documents(c.requests, c)


@query("source_search", f"""
SELECT query_id, rank, source_id, text_rank, page_quality, {S.iso('latest_document_at')} AS latest_document_at
FROM v_source_ranks WHERE rank <= 25""")
def source_search(c: Corpus):
    return R.search_sources(c.requests, c, 25).withColumn("latest_document_at", iso("latest_document_at"))


@query("program_filter", """
SELECT query_id, program_id, structured_score FROM v_exact_programs JOIN v_requests r USING (query_id) WHERE r.query <> ''""")
def program_filter(c: Corpus):
    """Every exact match that passes the hard filters, with its filter score."""
    matches = R.match_documents(c.requests, c, (R.EXACT,))
    asked = c.requests.select("query_id", *R.FILTERS)
    rows = matches.join(R.shelf(c).programs, "doc_id").join(asked, "query_id").where(R._passes())
    return rows.select("query_id", "program_id", R.structured_score().alias("structured_score"))


_RANKED = ("query_id", "rank", "program_id", "doc_id", "source_id", "text_rank", "confidence", "page_quality")


@query("program_search_exact", f"""
SELECT {', '.join(_RANKED)}, structured_score, {S.iso('newest_crawl')} AS newest_crawl FROM v_exact_programs WHERE rank <= 25""")
def program_search_exact(c: Corpus):
    s = R.shelf(c)
    rows = R.exact_programs(c.requests, R.search_shards(c.requests, c, exact=25), 25)
    keep = [*_RANKED, "structured_score", "newest_crawl"]
    both = rows.select(*keep).unionByName(R.browse_programs(c.requests, s, 25).select(*keep))
    return both.withColumn("newest_crawl", iso("newest_crawl"))


@query("program_search_fallback", f"SELECT {', '.join(_RANKED)}, intent_score FROM v_expanded_programs WHERE rank <= 50")
def program_search_fallback(c: Corpus):
    rows = R.expanded_programs(R.search_shards(c.requests, c, expanded=50), 50)
    return rows.select(*_RANKED, "intent_score")


@query("program_search", f"SELECT * FROM {program_search_sql(25)}")
def program_search(c: Corpus):
    return R.search_programs(c.requests, c, 25)


@query("page_quality", f"SELECT id, canonical_url, {S.page_quality('canonical_url')} AS page_quality FROM v_sources")
def page_quality(c: Corpus):
    return c.sources.select(
        "id", "canonical_url", U.page_quality_score(F.col("canonical_url")).cast("long").alias("page_quality")
    )


# -- stems and distances -----------------------------------------------------------
view("v_token_places", f"""
SELECT doc_id, pos, token FROM (SELECT doc_id, unnest(ts) AS token, generate_subscripts(ts, 1) AS pos
  FROM (SELECT doc_id, {S.tokens('content')} AS ts FROM v_content)) WHERE token NOT IN ({S.STOP})""")
view("v_vocabulary", stems_sql("SELECT token, count(DISTINCT doc_id) AS n_docs FROM v_token_places GROUP BY token"))
# The titles of documents as requests: all of them, whole.
view("v_titles", "SELECT id AS query_id, title AS query FROM v_documents WHERE title <> ''")


def titles(c: Corpus):
    none = {f: F.lit(None).cast("long" if f == "days_per_week" else "string").alias(f) for f in R.FILTERS}
    return c.documents.where("title <> ''").select(F.col("id").alias("query_id"), F.col("title").alias("query"), *none.values())


@query("vocabulary_stems", "SELECT token, n_docs, stem FROM v_vocabulary")
def vocabulary_stems(c: Corpus):
    """Every distinct token of the documents with its stem."""
    return IX.vocabulary(c)


@query("stem_matches", f"""
WITH words AS (SELECT DISTINCT query_id, unnest({S.tokens('query')}) AS token FROM v_titles),
asked AS (SELECT DISTINCT w.query_id, s.stem FROM words w JOIN ({stems_sql("SELECT DISTINCT token FROM (SELECT unnest(" + S.tokens('query') + ") AS token FROM v_titles)")}) s USING (token)
  WHERE token NOT IN ({S.STOP})),
tf AS (SELECT p.doc_id, v.stem, count(*) AS tf FROM v_token_places p JOIN v_vocabulary v USING (token) GROUP BY ALL),
w AS (SELECT doc_id, stem, {_weight} AS w FROM tf WHERE stem IN (SELECT stem FROM asked)),
n AS (SELECT query_id, count(*) AS n FROM asked GROUP BY 1)
SELECT a.query_id, w.doc_id, round(sum(w.w) / max(n.n), 6) AS text_rank FROM asked a JOIN n USING (query_id) JOIN w USING (stem) GROUP BY a.query_id, w.doc_id HAVING count(*) = max(n.n)""")
def stem_matches(c: Corpus):
    """Which documents have all words of a title, by stems."""
    return R.stem_matches(titles(c), c)


@query("rank_proximity", f"""
WITH l AS (SELECT query_id, unnest(ls) AS lexeme, len(ls) AS n FROM (SELECT query_id, {lexeme_list('query')} AS ls FROM v_titles)),
m AS (SELECT l.query_id, t.doc_id, max(l.n) AS n, round(sum({_weight}) / max(l.n), 6) AS text_rank FROM l JOIN v_tf t USING (lexeme) GROUP BY 1, 2 HAVING count(*) = max(l.n)),
p AS (SELECT m.query_id, m.doc_id, l.lexeme, t.pos FROM m JOIN l USING (query_id) JOIN v_tokens t ON t.doc_id = m.doc_id AND t.lexeme = l.lexeme),
d AS (SELECT a.query_id, a.doc_id, sum(ln(1 - 0.1::DOUBLE * sqrt(1 / (1.005::DOUBLE + 0.05::DOUBLE * exp(abs(a.pos - b.pos) / 1.5::DOUBLE - 2))))) AS s
  FROM p a JOIN p b ON a.query_id = b.query_id AND a.doc_id = b.doc_id AND a.lexeme < b.lexeme AND abs(a.pos - b.pos) <= 100 GROUP BY 1, 2)
SELECT m.query_id, m.doc_id, CASE WHEN m.n < 2 THEN m.text_rank ELSE round(1 - exp(coalesce(d.s, 0)), 6) END AS rank_proximity FROM m LEFT JOIN d USING (query_id, doc_id)""")
def rank_proximity(c: Corpus):
    """How near the words of a title stand to each other in every document that has all of them."""
    return R.rank_proximity(titles(c), c)
