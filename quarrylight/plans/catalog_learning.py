"""Metrics, relevance datasets, labels, splits and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.functions import fixed_values as V
from quarrylight.functions import text as T
from quarrylight.operators import evaluate as E
from quarrylight.operators import labels as L
from quarrylight.operators import quality as Q
from quarrylight.operators import retrieve as R
from quarrylight.operators.groups import hashed_position
from quarrylight.plans import sqltext as S
from quarrylight.plans.catalog_answers import evidence_texts, program_texts
from quarrylight.plans.oracle_views import view
from quarrylight.plans.registry import query
from quarrylight.plans.search_views import program_search_sql
from quarrylight.sources.corpus import Corpus

# -- metrics over all labels: four documents of a page make one ranked list ---
view("v_lists", "SELECT document_id // 4 AS query_id, document_id % 4 + 1 AS rank, relevance FROM v_grades")


def lists(c: Corpus):
    d = F.col("document_id")
    return c.grades.select(F.floor(d / 4).alias("query_id"), (d % 4 + 1).alias("rank"), F.col("relevance").cast("long").alias("relevance"))


@query("precision_at_k", "SELECT query_id, round(count(*) FILTER (WHERE rank <= 3 AND relevance > 0) / 3.0::DOUBLE, 6) AS precision FROM v_lists GROUP BY 1")
def precision_at_k(c: Corpus):
    return E.precision_at_k(lists(c), 3)


@query("recall_at_k", """
SELECT t.query_id, round(CASE WHEN total > 0 THEN coalesce(found, 0) / total::DOUBLE ELSE 0 END, 6) AS recall
FROM (SELECT query_id, count(*) FILTER (WHERE relevance > 1) AS total FROM v_lists GROUP BY 1) t
LEFT JOIN (SELECT query_id, count(*) FILTER (WHERE rank <= 2 AND relevance > 1) AS found FROM v_lists GROUP BY 1) f USING (query_id)""")
def recall_at_k(c: Corpus):
    rows = lists(c).withColumn("relevance", F.col("relevance") - 1)
    totals = rows.groupBy("query_id").agg(F.count_if(F.col("relevance") > 0).alias("total_relevant"))
    return E.recall_at_k(rows, totals, 2)


@query("mrr", "SELECT query_id, round(coalesce(1.0::DOUBLE / min(rank) FILTER (WHERE relevance > 2), 0), 6) AS reciprocal_rank FROM v_lists GROUP BY 1")
def mrr(c: Corpus):
    return E.reciprocal_rank(lists(c).withColumn("relevance", F.col("relevance") - 2))


def _ndcg(source: str, k: int) -> str:
    return f"""SELECT query_id, round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END, 6) AS ndcg FROM (
  SELECT query_id, sum(CASE WHEN rank <= {k} THEN (pow(2, relevance) - 1) / log2(rank + 1) ELSE 0 END) AS dcg,
    sum(CASE WHEN best <= {k} THEN (pow(2, relevance) - 1) / log2(best + 1) ELSE 0 END) AS idcg
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC) AS best FROM {source}) GROUP BY 1)"""


@query("ndcg_at_k", _ndcg("v_lists", 3))
def ndcg_at_k(c: Corpus):
    return E.ndcg_at_k(lists(c), 3)


# -- pools -------------------------------------------------------------------
view("v_queries", "SELECT query_id, query, CASE WHEN query_id % 5 = 4 THEN 'source_evidence' ELSE 'program' END AS candidate_collection FROM v_requests")
view("v_existing", """
SELECT q.query_id, p.program_id, 'manual' AS candidate_source FROM v_grades g
JOIN (SELECT document_id, min(id) AS program_id FROM v_programs GROUP BY 1) p USING (document_id)
JOIN (SELECT query_id, row_number() OVER (ORDER BY md5(CAST(query_id AS VARCHAR))) - 1 AS position, count(*) OVER () AS n
  FROM v_queries WHERE candidate_collection = 'program') q ON q.position = g.document_id % q.n""")


def dataset_queries(c: Corpus):
    kind = F.when(F.col("query_id") % 5 == 4, "source_evidence").otherwise("program")
    return c.requests.select("query_id", "query", kind.alias("candidate_collection"))


def plain_requests(c: Corpus):
    """The requests without any filter, as datasets use them."""
    typed = dict(c.requests.dtypes)
    return c.requests.select("query_id", "query", *[F.lit(None).cast(typed[f]).alias(f) for f in R.FILTERS])


def existing(c: Corpus):
    """The first program of every labelled document, spread over all program queries in hashed order."""
    asked = dataset_queries(c).where("candidate_collection = 'program'").select("query_id")
    places = hashed_position(asked, F.col("query_id"))
    first = c.programs.groupBy("document_id").agg(F.min("id").alias("program_id"))
    rows = c.grades.select("document_id").join(first, "document_id").withColumn("n", asked.agg(F.count("*")).scalar()).where("n > 0")
    rows = rows.withColumn("position", F.pmod("document_id", "n")).join(places, "position")
    return rows.select("query_id", "program_id", F.lit("manual").alias("candidate_source"))


#: Search results of a query that enter its pool.
POOL_DEPTH = 50


def pools(c: Corpus):
    """The candidate pools of both collections, stored once."""
    return c.keep("pools", lambda: _pools(c))


def retrieved(c: Corpus):
    """What search gives for each dataset query, to the depth of the pools: stored once, read by pools, rankings and features."""

    def build():
        plain, kinds = plain_requests(c), dataset_queries(c)
        of_programs, of_sources = (plain.join(kinds.where(F.col("candidate_collection") == k), "query_id", "left_semi") for k in ("program", "source_evidence"))
        found = R.search_programs(of_programs, c, POOL_DEPTH).select("query_id", "program_id", F.lit(None).cast("long").alias("source_id"), "rank", "leg", "text_rank")
        seen = R.search_sources(of_sources, c, POOL_DEPTH).select("query_id", F.lit(None).cast("long").alias("program_id"), "source_id", "rank", F.lit(R.EXACT).alias("leg"), "text_rank")
        return found.unionByName(seen)

    return c.keep("retrieved", build)


def _pools(c: Corpus):
    qs = dataset_queries(c)
    of_programs = qs.where("candidate_collection = 'program'")
    of_sources = qs.where("candidate_collection = 'source_evidence'")
    found = retrieved(c).where("program_id IS NOT NULL").select("query_id", "program_id", "rank")
    seen = retrieved(c).where("source_id IS NOT NULL").select("query_id", "source_id", "rank")
    programs = L.candidate_pool(of_programs, existing(c), found, c.programs.select(F.col("id").alias("program_id")), "program_id", 10)
    with_doc = c.sources.where("latest_document_id IS NOT NULL").select(F.col("id").alias("source_id"))
    none = seen.where("false").select("query_id", "source_id", F.lit("").alias("candidate_source"))
    sources = L.candidate_pool(of_sources, none, seen, with_doc, "source_id", 10)
    nothing = F.lit(None).cast("long")
    both = programs.withColumn("source_id", nothing).unionByName(sources.withColumn("program_id", nothing))
    urls_p = R.shelf(c).programs.select("program_id", F.col("canonical_url").alias("url_p"))
    urls_s = R.shelf_sources(c).select("source_id", F.col("canonical_url").alias("url_s"))
    rows = both.join(urls_p, "program_id", "left").join(urls_s, "source_id", "left")
    return rows.select(
        "query_id", "program_id", "source_id", F.coalesce("url_p", "url_s").alias("canonical_url"), "candidate_source", "baseline_rank", "candidate_no"
    )


def _negatives(item: str, items: str, known: str, collection: str) -> str:
    return f"""
SELECT query_id, {item}, row_number() OVER (PARTITION BY query_id ORDER BY dist) AS no FROM (
  SELECT q.query_id, r.{item}, (r.place - CAST('0x' || substr(md5('42-' || q.query_id), 1, 8) AS BIGINT) % r.total + r.total) % r.total AS dist
  FROM (SELECT query_id FROM v_queries WHERE candidate_collection = '{collection}') q,
    (SELECT {item}, row_number() OVER (ORDER BY md5('42-' || {item})) - 1 AS place, count(*) OVER () AS total FROM ({items})) r
  WHERE NOT EXISTS (SELECT 1 FROM ({known}) k WHERE k.query_id = q.query_id AND k.{item} = r.{item}))
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dist) <= 10"""


view("v_found", f"SELECT query_id, program_id, rank, leg, text_rank FROM {program_search_sql(50, 'v_plain_')} JOIN v_queries USING (query_id) WHERE candidate_collection = 'program'")
view("v_seen", "SELECT query_id, source_id, rank, text_rank FROM v_plain_source_ranks JOIN v_queries USING (query_id) WHERE candidate_collection = 'source_evidence' AND rank <= 50")
view("v_negative_programs", _negatives(
    "program_id", "SELECT id AS program_id FROM v_programs",
    "SELECT query_id, program_id FROM v_existing UNION ALL SELECT query_id, program_id FROM v_found", "program"))
view("v_negative_sources", _negatives(
    "source_id", "SELECT id AS source_id FROM v_sources WHERE latest_document_id IS NOT NULL", "SELECT query_id, source_id FROM v_seen", "source_evidence"))
view("v_pools", f"""
SELECT p.query_id, p.program_id, p.source_id, coalesce(a.canonical_url, b.canonical_url) AS canonical_url, p.candidate_source, p.baseline_rank,
  row_number() OVER (PARTITION BY p.query_id ORDER BY part, no) AS candidate_no
FROM (SELECT query_id, program_id, NULL::BIGINT AS source_id, candidate_source, NULL::BIGINT AS baseline_rank, 0 AS part, program_id AS no FROM v_existing
  UNION ALL SELECT query_id, program_id, NULL, '{V.HARD_CANDIDATE}', rank, 1, rank FROM v_found f
    WHERE NOT EXISTS (SELECT 1 FROM v_existing e WHERE e.query_id = f.query_id AND e.program_id = f.program_id)
  UNION ALL SELECT query_id, program_id, NULL, '{V.RANDOM_NEGATIVE}', NULL, 2, no FROM v_negative_programs
  UNION ALL SELECT query_id, NULL, source_id, '{V.HARD_CANDIDATE}', rank, 1, rank FROM v_seen
  UNION ALL SELECT query_id, NULL, source_id, '{V.RANDOM_NEGATIVE}', NULL, 2, no FROM v_negative_sources) p
LEFT JOIN v_shelf_programs a ON a.program_id = p.program_id LEFT JOIN v_shelf_sources b ON b.source_id = p.source_id""")


@query("candidate_pools", "SELECT * FROM v_pools")
def candidate_pools(c: Corpus):
    return _pools(c)


# -- labels ------------------------------------------------------------------
view("v_pool_text", """
SELECT p.*, q.query, coalesce(a.text, b.text) AS text FROM v_pools p JOIN v_queries q USING (query_id)
LEFT JOIN v_program_text a ON a.program_id = p.program_id LEFT JOIN v_evidence_text b ON b.source_id = p.source_id""")
view("v_bootstrap", f"""
SELECT query_id, program_id, source_id, baseline_rank, candidate_no, score, '{V.TEACHER_REASON}' AS reason,
  CASE WHEN r <= 2 THEN 3 WHEN r <= 5 THEN 2 WHEN r <= 10 THEN 1 ELSE 0 END AS relevance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_no) AS r
  FROM (SELECT *, round(len(list_intersect(list_distinct({S.tokens('query')}), {S.tokens('text')})) / greatest(len(list_distinct({S.tokens('query')})), 1)::DOUBLE, 6) AS score
    FROM v_pool_text))""")
view("v_human", """
SELECT query_id, program_id, (query_id + program_id) % 4 AS relevance FROM v_pools WHERE program_id IS NOT NULL AND (query_id + program_id) % 11 = 0
UNION ALL SELECT query_id, -query_id - 1, 2 FROM v_queries WHERE query_id % 25 = 3""")
view("v_labels", f"""
SELECT b.query_id, b.program_id, b.source_id, b.baseline_rank, b.candidate_no, coalesce(h.relevance, b.relevance) AS relevance,
  CASE WHEN h.relevance IS NOT NULL THEN '{V.HUMAN_REASON}' ELSE b.reason END AS reason
FROM v_bootstrap b LEFT JOIN v_human h ON h.query_id = b.query_id AND h.program_id = b.program_id""")


def pool_texts(c: Corpus):
    rows = pools(c).join(c.requests.select("query_id", "query"), "query_id")
    a = program_texts(c, pools(c)).withColumnRenamed("text", "text_a")
    b = evidence_texts(c, pools(c)).withColumnRenamed("text", "text_b")
    rows = rows.join(a, "program_id", "left").join(b, "source_id", "left")
    return rows.withColumn("text", F.coalesce("text_a", "text_b")).drop("text_a", "text_b")


def bootstrap(c: Corpus):
    return c.keep("bootstrap", lambda: _bootstrap(c))


def _bootstrap(c: Corpus):
    keep = ("query_id", "program_id", "source_id", "baseline_rank", "candidate_no", "score")
    rows = pools(c).join(c.requests.select("query_id", "query"), "query_id")
    # Each collection meets its own words and is scored there, so no row carries words on.
    parts = []
    for item, texts in (("program_id", program_texts), ("source_id", evidence_texts)):
        own = pools(c).where(F.col(item).isNotNull())
        words = texts(c, own).select(item, F.array_distinct(T.tokens(F.col("text"))).alias("words"))
        scored = rows.where(F.col(item).isNotNull()).join(words, item, "left").withColumn("score", L.teacher_score(F.col("query"), F.col("words")))
        parts.append(scored.select(*keep))
    return L.bootstrap_labels(parts[0].unionByName(parts[1]))


def human(c: Corpus):
    s = F.col("query_id") + F.col("program_id")
    known = pools(c).where(F.col("program_id").isNotNull() & (s % 11 == 0)).select("query_id", "program_id", (s % 4).alias("relevance"))
    q = F.col("query_id")
    wrong = c.requests.where(q % 25 == 3).select("query_id", (-q - 1).alias("program_id"), F.lit(2).cast("long").alias("relevance"))
    return known.unionByName(wrong)


def labels(c: Corpus):
    return L.human_overrides(bootstrap(c), human(c)).drop("score")


@query("bootstrap_labels", "SELECT * FROM v_bootstrap")
def bootstrap_labels(c: Corpus):
    return _bootstrap(c)


@query("human_overrides", "SELECT * FROM v_labels")
def human_overrides(c: Corpus):
    return labels(c)


@query("human_unmatched", """
SELECT query_id, program_id, relevance FROM v_human h WHERE NOT EXISTS (SELECT 1 FROM v_pools p WHERE p.query_id = h.query_id AND p.program_id = h.program_id)""")
def human_unmatched(c: Corpus):
    return L.unmatched_judgments(bootstrap(c), human(c))


# -- splits and pairs --------------------------------------------------------
view("v_order", "SELECT query_id, row_number() OVER (ORDER BY md5('42-' || query_id)) - 1 AS position, count(*) OVER () AS n FROM v_queries")
view("v_asked_order", "SELECT query_id, row_number() OVER (ORDER BY md5('42-' || query_id)) - 1 AS position, count(*) OVER () AS n FROM v_asked")
view("v_splits", """
SELECT query_id, CASE WHEN position < t THEN 'train' WHEN position < least(greatest(v, t + 1), n - 1) THEN 'validation' ELSE 'test' END AS split
FROM (SELECT *, least(greatest(round_even(n * 0.70::DOUBLE, 0), 1), n - 2) AS t, round_even(n * 0.70::DOUBLE, 0) + round_even(n * 0.15::DOUBLE, 0) AS v FROM v_asked_order)""")
view("v_train_splits", """
WITH b AS (SELECT *, greatest(1, round_even(n * 0.70::DOUBLE, 0)) AS t FROM v_order),
e AS (SELECT *, least(greatest(t + 1, t + round_even(n * 0.15::DOUBLE, 0)), n - 1) - t AS want FROM b),
r AS (SELECT *, position < t OR query_id IN (SELECT query_id FROM v_labels WHERE reason = 'human_authoritative_v1') AS trains FROM e),
h AS (SELECT query_id, want, row_number() OVER (ORDER BY position) - 1 AS p, count(*) OVER () AS rest FROM r WHERE NOT trains)
SELECT query_id, 'train' AS split FROM r WHERE trains
UNION ALL SELECT query_id, CASE WHEN rest >= 2 AND p < least(rest - 1, greatest(1, want)) THEN 'validation' ELSE 'test' END FROM h""")


def train_split_of(c: Corpus):
    own = labels(c).where(F.col("reason") == V.HUMAN_REASON).select("query_id").distinct()
    return L.train_splits(c.requests, own)


@query("query_splits", "SELECT * FROM v_splits")
def query_splits(c: Corpus):
    """A part for every request, those that the service rejects included."""
    return L.query_splits(c.asked)


@query("train_splits", "SELECT * FROM v_train_splits")
def train_splits(c: Corpus):
    return train_split_of(c)


@query("training_pairs", f"""
SELECT l.query_id, l.program_id, l.source_id, t.query, md5(t.text) AS text_md5, l.relevance, l.baseline_rank, s.split, c.copy
FROM v_labels l JOIN v_train_splits s USING (query_id) JOIN v_pool_text t ON t.query_id = l.query_id AND t.candidate_no = l.candidate_no,
  unnest(range(1, CASE WHEN l.reason = '{V.HUMAN_REASON}' AND s.split = 'train' THEN 6 ELSE 2 END)) AS c(copy)""")
def training_pairs(c: Corpus):
    texts = pool_texts(c).select("query_id", "candidate_no", "query", F.md5(F.col("text").cast("binary")).alias("text_md5"))
    rows = L.training_pairs(labels(c), train_split_of(c)).join(texts, ["query_id", "candidate_no"])
    return rows.select("query_id", "program_id", "source_id", "query", "text_md5", "relevance", "baseline_rank", "split", F.col("copy").cast("long").alias("copy"))


# -- baseline evaluation -----------------------------------------------------
view("v_judged", """
SELECT p.query_id, p.program_id, p.source_id, g.relevance FROM v_pools p LEFT JOIN v_programs x ON x.id = p.program_id LEFT JOIN v_sources s ON s.id = p.source_id
JOIN v_grades g ON g.document_id = coalesce(x.document_id, s.latest_document_id)""")
view("v_observed", """
SELECT query_id, relevance, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM (
  SELECT f.query_id, f.rank, j.relevance FROM v_found f JOIN v_judged j ON j.query_id = f.query_id AND j.program_id = f.program_id
  UNION ALL SELECT f.query_id, f.rank, j.relevance FROM v_seen f JOIN v_judged j ON j.query_id = f.query_id AND j.source_id = f.source_id)""")


def judged(c: Corpus):
    """Pool rows whose document has a label."""
    docs = c.programs.select(F.col("id").alias("program_id"), F.col("document_id").alias("d1"))
    src = c.sources.select(F.col("id").alias("source_id"), F.col("latest_document_id").alias("d2"))
    rows = pools(c).join(docs, "program_id", "left").join(src, "source_id", "left")
    rows = rows.withColumn("document_id", F.coalesce("d1", "d2")).join(c.grades, "document_id")
    return rows.select("query_id", "program_id", "source_id", "canonical_url", "baseline_rank", F.col("relevance").cast("long").alias("relevance"))


def rankings(c: Corpus):
    """The labelled part of each stored search result, ranked densely, with ids, URL, score and grade. Nothing is searched."""
    marks = judged(c)
    keep = ("query_id", "rank", "program_id", "source_id", "canonical_url", "text_rank", "relevance")
    parts = []
    for item in ("program_id", "source_id"):
        shown = retrieved(c).where(F.col(item).isNotNull()).select("query_id", item, "rank", "text_rank")
        urls = marks.where(F.col(item).isNotNull()).select("query_id", item, "canonical_url")
        other = "source_id" if item == "program_id" else "program_id"
        ranked = E.labelled_ranking(shown, marks.where(F.col(item).isNotNull()), item).join(urls, ["query_id", item])
        parts.append(ranked.withColumn(other, F.lit(None).cast("long")).select(*keep))
    return parts[0].unionByName(parts[1]), marks


view("v_rankings", """
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, program_id, source_id, canonical_url, text_rank, relevance FROM (
  SELECT f.query_id, f.rank, f.program_id, NULL::BIGINT AS source_id, p.canonical_url, f.text_rank, j.relevance
  FROM v_found f JOIN v_judged j ON j.query_id = f.query_id AND j.program_id = f.program_id JOIN v_shelf_programs p ON p.program_id = f.program_id
  UNION ALL SELECT f.query_id, f.rank, NULL, f.source_id, s.canonical_url, f.text_rank, j.relevance
  FROM v_seen f JOIN v_judged j ON j.query_id = f.query_id AND j.source_id = f.source_id JOIN v_shelf_sources s ON s.source_id = f.source_id)""")


@query("baseline_rankings", "SELECT * FROM v_rankings")
def baseline_rankings(c: Corpus):
    return rankings(c)[0]


@query("error_template", f"""
SELECT q.query_id, q.query, NULL::VARCHAR AS category, NULL::VARCHAR AS notes, 'draft' AS status, '{"|".join(V.ERROR_CATEGORIES)}' AS allowed_categories,
  coalesce(string_agg(r.rank || ' ' || coalesce('program:' || r.program_id, 'source:' || r.source_id) || ' ' || r.relevance, '|' ORDER BY r.rank), '') AS ranking
FROM v_queries q JOIN (SELECT DISTINCT query_id FROM v_judged) j USING (query_id) LEFT JOIN v_rankings r USING (query_id) GROUP BY q.query_id, q.query""")
def error_template(c: Corpus):
    """The sheet that reviewers fill in: every judged query with its ranking and no category yet."""
    ranked, marks = rankings(c)
    return L.error_template(dataset_queries(c).join(marks.select("query_id").distinct(), "query_id", "left_semi"), ranked)


view("v_baseline", f"""
SELECT t.query_id, round(CASE WHEN total > 0 THEN coalesce(found, 0) / total::DOUBLE ELSE 0 END, 6) AS recall, round(coalesce(found, 0) / 10.0::DOUBLE, 6) AS precision,
  round(coalesce(1.0::DOUBLE / first_hit, 0), 6) AS reciprocal_rank, coalesce(n.ndcg, 0) AS ndcg
FROM (SELECT query_id, count(*) FILTER (WHERE relevance > 0) AS total FROM v_judged GROUP BY 1) t
LEFT JOIN (SELECT query_id, count(*) FILTER (WHERE rank <= 10 AND relevance > 0) AS found, min(rank) FILTER (WHERE relevance > 0) AS first_hit FROM v_observed GROUP BY 1) o USING (query_id)
LEFT JOIN ({_ndcg('v_observed', 10)}) n USING (query_id)""")


def baseline_metrics(c: Corpus):
    observed, marks = rankings(c)
    totals = marks.groupBy("query_id").agg(F.count_if(F.col("relevance") > 0).alias("total_relevant"))
    return E.evaluate(observed, totals, 10)


@query("baseline_queries", "SELECT * FROM v_baseline")
def baseline_queries(c: Corpus):
    return baseline_metrics(c)


@query("baseline_eval", """
SELECT count(*) AS queries, round(avg(ndcg), 10) AS ndcg, round(avg(reciprocal_rank), 10) AS reciprocal_rank, round(avg(recall), 10) AS recall,
  round(avg(precision), 10) AS precision FROM v_baseline""")
def baseline_eval(c: Corpus):
    return E.means(baseline_metrics(c))


view("v_reviews", f"""
SELECT query_id, {S.pick('query_id % 12', (*V.ERROR_CATEGORIES, 'nonsense', '', None))} AS category FROM v_baseline""")


@query("error_summary", f"""
SELECT category, count(*) AS reviews, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM v_reviews WHERE category IN ({S.quoted(V.ERROR_CATEGORIES)}) GROUP BY 1
UNION ALL SELECT '(unreviewed)', count(*) FILTER (WHERE coalesce(category, '') = ''), NULL FROM v_reviews""")
def error_summary(c: Corpus):
    from quarrylight.sources.corpus import pick

    marks = judged(c).select("query_id").distinct()
    reviews = marks.select("query_id", pick(F.col("query_id") % 12, (*V.ERROR_CATEGORIES, "nonsense", "", None)).alias("category"))
    return L.error_summary(reviews)


# -- data quality ------------------------------------------------------------
@query("dataset_violations", f"""
WITH q AS (SELECT CAST(query_id AS VARCHAR) AS query_id, CASE WHEN query_id % 17 = 3 THEN '' ELSE query END AS query,
    CASE WHEN query_id % 19 = 5 THEN 'pages' ELSE candidate_collection END AS candidate_collection,
    CASE WHEN query_id % 23 = 7 THEN 'open' WHEN query_id % 2 = 0 THEN 'frozen' ELSE 'draft' END AS status FROM v_queries
  UNION ALL SELECT CAST(query_id AS VARCHAR), query, candidate_collection, 'draft' FROM v_queries WHERE query_id % 29 = 1),
k AS (SELECT CAST(query_id AS VARCHAR) AS query_id, CASE WHEN program_id IS NOT NULL THEN 'program:' || (CASE WHEN program_id % 31 = 0 THEN 1 ELSE program_id END) ELSE 'source:' || source_id END AS key,
    CASE WHEN candidate_no % 13 = 0 THEN NULL WHEN candidate_no % 14 = 0 THEN 7 ELSE relevance END AS relevance FROM v_labels)
SELECT 'query_incomplete' AS rule, query_id AS key FROM q WHERE query_id = '' OR query = ''
UNION ALL SELECT 'unknown_collection', query_id FROM q WHERE candidate_collection NOT IN ('program', 'source_evidence')
UNION ALL SELECT 'unknown_status', query_id FROM q WHERE status NOT IN ('draft', 'frozen')
UNION ALL SELECT 'query_id_repeated', query_id FROM q GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'candidate_repeated', query_id || '/' || key FROM k GROUP BY query_id, key HAVING count(*) > 1
UNION ALL SELECT 'grade_out_of_range', query_id || '/' || key FROM k WHERE relevance NOT IN (0, 1, 2, 3)
UNION ALL SELECT 'unjudged_in_frozen', k.query_id || '/' || k.key FROM k JOIN q USING (query_id) WHERE q.status = 'frozen' AND k.relevance IS NULL""")
def dataset_violations(c: Corpus):
    """Checks over the dataset with some of its rows broken on purpose."""
    q, n = F.col("query_id"), F.col("candidate_no")
    base = dataset_queries(c)
    broken = base.select(
        q.cast("string").alias("query_id"), F.when(q % 17 == 3, "").otherwise(F.col("query")).alias("query"),
        F.when(q % 19 == 5, "pages").otherwise(F.col("candidate_collection")).alias("candidate_collection"),
        F.when(q % 23 == 7, "open").when(q % 2 == 0, "frozen").otherwise("draft").alias("status"),
    )
    again = base.where(q % 29 == 1).select(q.cast("string").alias("query_id"), "query", "candidate_collection", F.lit("draft").alias("status"))
    rows = labels(c).withColumn("program_id", F.when(F.col("program_id") % 31 == 0, 1).otherwise(F.col("program_id"))).withColumn("canonical_url", F.lit(None).cast("string"))
    grade = F.when(n % 13 == 0, F.lit(None)).when(n % 14 == 0, 7).otherwise(F.col("relevance"))
    cand = rows.select(q.cast("string").alias("query_id"), L.candidate_key().alias("key"), grade.alias("relevance"))
    return Q.dataset_violations(broken.unionByName(again), cand)


@query("experiment_name", """
SELECT CASE WHEN count(DISTINCT candidate_collection) <> 1 THEN NULL WHEN min(candidate_collection) = 'program' THEN 'program_search_baseline' ELSE 'source_search_baseline' END AS experiment,
  'both' AS part FROM v_queries
UNION ALL SELECT 'program_search_baseline', 'programs' FROM v_queries WHERE candidate_collection = 'program' HAVING count(*) > 0""")
def experiment_name(c: Corpus):
    qs = dataset_queries(c)
    return Q.experiment_name(qs).withColumn("part", F.lit("both")).unionByName(
        Q.experiment_name(qs.where("candidate_collection = 'program'")).withColumn("part", F.lit("programs"))
    )


@query("corpus_violations", """
WITH d AS (SELECT id, domain FROM v_domains UNION ALL SELECT id + 10000000000, domain FROM v_domains WHERE id % 10 = 0),
s AS (SELECT id, canonical_url, domain_id, latest_document_id FROM v_sources
  UNION ALL SELECT id + 10000000000, canonical_url, domain_id, latest_document_id FROM v_sources WHERE id % 15 = 0
  UNION ALL SELECT id + 20000000000, canonical_url || '?a', -id, NULL FROM v_sources WHERE id % 17 = 5
  UNION ALL SELECT id + 30000000000, canonical_url || '?b', domain_id, -id FROM v_sources WHERE id % 19 = 3),
j AS (SELECT id, source_id FROM v_crawl_jobs UNION ALL SELECT id + 10000000000, -id FROM v_crawl_jobs WHERE id % 37 = 1),
o AS (SELECT id, source_id, crawl_job_id FROM v_documents UNION ALL SELECT id + 10000000000, -id, NULL FROM v_documents WHERE id % 25 = 2
  UNION ALL SELECT id + 20000000000, source_id, -id FROM v_documents WHERE id % 26 = 1),
p AS (SELECT id, document_id, confidence FROM v_programs UNION ALL SELECT id + 10000000000, -document_id - 1, confidence FROM v_programs WHERE id % 41 = 0
  UNION ALL SELECT id + 20000000000, document_id, confidence + 1 FROM v_programs WHERE id % 50 = 1 UNION ALL SELECT id + 30000000000, document_id, -0.5 FROM v_programs WHERE id % 50 = 2),
c AS (SELECT id, document_id, CASE WHEN document_id % 3 > 0 THEN document_id * 10 + 1 END AS program_id, confidence FROM v_claim_refs
  UNION ALL SELECT id + 10000000000, -document_id - 1, NULL, confidence FROM v_claim_refs WHERE id % 31 = 1
  UNION ALL SELECT id + 20000000000, document_id, -id, confidence + 1 FROM v_claim_refs WHERE id % 43 = 1)
SELECT 'domain_unique' AS rule, domain AS key FROM d GROUP BY domain HAVING count(*) > 1
UNION ALL SELECT 'canonical_url_unique', canonical_url FROM s GROUP BY canonical_url HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'source_domain', CAST(domain_id AS VARCHAR) FROM s WHERE domain_id NOT IN (SELECT id FROM d)
UNION ALL SELECT DISTINCT 'source_latest_document', CAST(latest_document_id AS VARCHAR) FROM s WHERE latest_document_id IS NOT NULL AND latest_document_id NOT IN (SELECT id FROM o)
UNION ALL SELECT DISTINCT 'crawl_source', CAST(source_id AS VARCHAR) FROM j WHERE source_id IS NOT NULL AND source_id NOT IN (SELECT id FROM s)
UNION ALL SELECT DISTINCT 'document_source', CAST(source_id AS VARCHAR) FROM o WHERE source_id NOT IN (SELECT id FROM s)
UNION ALL SELECT DISTINCT 'document_crawl', CAST(crawl_job_id AS VARCHAR) FROM o WHERE crawl_job_id IS NOT NULL AND crawl_job_id NOT IN (SELECT id FROM j)
UNION ALL SELECT DISTINCT 'program_document', CAST(document_id AS VARCHAR) FROM p WHERE document_id NOT IN (SELECT id FROM o)
UNION ALL SELECT DISTINCT 'claim_document', CAST(document_id AS VARCHAR) FROM c WHERE document_id NOT IN (SELECT id FROM o)
UNION ALL SELECT DISTINCT 'claim_program', CAST(program_id AS VARCHAR) FROM c WHERE program_id IS NOT NULL AND program_id NOT IN (SELECT id FROM p)
UNION ALL SELECT 'program_confidence', CAST(id AS VARCHAR) FROM p WHERE confidence < 0 OR confidence > 1
UNION ALL SELECT 'claim_confidence', CAST(id AS VARCHAR) FROM c WHERE confidence < 0 OR confidence > 1""")
def corpus_violations(c: Corpus):
    """Checks over the whole corpus, to which broken rows are added."""
    i, conf, far = F.col("id"), F.col("confidence"), 10_000_000_000
    none = F.lit(None).cast("long")

    def also(rows, where, *columns, step=1):
        """Rows once more under other ids, with ``columns`` in place of those after the id."""
        return rows.where(where).select((i + step * far).alias("id"), *[x.alias(n) for n, x in zip(rows.columns[1:], columns, strict=True)])

    d = c.domains.select("id", "domain")
    d = d.unionByName(also(d, i % 10 == 0, F.col("domain")))
    s = c.sources.select("id", "canonical_url", "domain_id", "latest_document_id")
    url, home, latest = F.col("canonical_url"), F.col("domain_id"), F.col("latest_document_id")
    s = (
        s.unionByName(also(s, i % 15 == 0, url, home, latest)).unionByName(also(s, i % 17 == 5, F.concat(url, F.lit("?a")), -i, none, step=2))
        .unionByName(also(s, i % 19 == 3, F.concat(url, F.lit("?b")), home, -i, step=3))
    )
    j = c.crawl_jobs.select("id", "source_id")
    j = j.unionByName(also(j, i % 37 == 1, -i))
    o = c.documents.select("id", "source_id", "crawl_job_id")
    o = o.unionByName(also(o, i % 25 == 2, -i, none)).unionByName(also(o, i % 26 == 1, F.col("source_id"), -i, step=2))
    doc = F.col("document_id")
    p = c.programs.select("id", "document_id", "confidence")
    p = (
        p.unionByName(also(p, i % 41 == 0, -doc - 1, conf)).unionByName(also(p, i % 50 == 1, doc, conf + 1, step=2))
        .unionByName(also(p, i % 50 == 2, doc, F.lit(-0.5), step=3))
    )
    k = c.claim_refs.select("id", "document_id", F.when(doc % 3 > 0, doc * 10 + 1).alias("program_id"), "confidence")
    k = k.unionByName(also(k, i % 31 == 1, -doc - 1, none, conf)).unionByName(also(k, i % 43 == 1, doc, -i, conf + 1, step=2))
    return Q.corpus_violations(d, s, j, o, p, k)
