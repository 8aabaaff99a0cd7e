"""Batch retrieval: all requests of a batch are answered in one job.

A request row holds ``query_id``, ``query`` and the nullable filter columns
``days_per_week, specialization, experience_level, progression_type,
split_type, domain``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import fixed_values as V
from quarrylight.functions import intent as I
from quarrylight.functions import text as T
from quarrylight.functions import urls as U
from quarrylight.operators.groups import top_n
from quarrylight.operators import index as IX
from quarrylight.operators import shards as SH
from quarrylight.operators.shards import EXACT, EXPANDED
from quarrylight.operators.stems import stems
from quarrylight.sources.corpus import Corpus

FILTERS = ("days_per_week", "specialization", "experience_level", "progression_type", "split_type", "domain")
def as_asked(requests: DataFrame) -> DataFrame:
    """Requests as the operators read them: no text is empty text, and an empty filter of these four is no filter."""
    blank = ("specialization", "experience_level", "progression_type", "split_type")
    return requests.withColumns({
        "query": F.coalesce("query", F.lit("")), **{f: F.nullif(F.col(f), F.lit("")) for f in blank if f in requests.columns},
    })


def query_lexemes(requests: DataFrame) -> DataFrame:
    """(query_id, lexeme, n_lexemes) of the all-terms query."""
    lex = requests.select("query_id", T.lexemes(F.col("query")).alias("ls"))
    return lex.select("query_id", F.explode("ls").alias("lexeme"), F.size("ls").alias("n_lexemes"))


def expand_requests(requests: DataFrame) -> DataFrame:
    """Requests with expanded ``terms`` and inferred constraints."""
    q = F.col("query")
    return requests.select(
        "query_id", "query", I.expanded_terms(q).alias("terms"), I.intent_days(q).alias("intent_days"),
        I.intent_experience(q).alias("intent_experience"), I.intent_split(q).alias("intent_split"),
    )


def expanded_groups(requests: DataFrame) -> DataFrame:
    """(query_id, groups): one lexeme set per expanded term, any of which is enough."""
    rows = requests.where("query <> ''").select("query_id", I.expanded_terms(F.col("query")).alias("terms"))
    return _with_groups(rows).select("query_id", "groups")


def _with_groups(rows: DataFrame) -> DataFrame:
    """Each step is a column of its own: what a later one names twice is computed once."""
    rows = rows.withColumn("terms", F.when(F.size("terms") > 0, F.col("terms")).otherwise(F.array(F.lit(V.EMPTY_EXPANSION_QUERY))))
    return rows.withColumn("groups", F.filter(F.transform("terms", T.lexemes), lambda g: F.size(g) > 0))


def asks(requests: DataFrame, expanded: bool = True) -> DataFrame:
    """(ask): what a shard needs of each request with text: lexemes of the exact leg, groups of the expanded one, filters, intents.

    Without the ``expanded`` leg there are no groups and no intents.
    """
    q = F.col("query")
    if not expanded:
        days = [F.col("days_per_week").cast("long").alias("days_per_week"), F.lit(None).cast("long").alias("intent_days")]
        wishes = [F.lit(None).cast("string").alias(f) for f in ("intent_experience", "intent_split")]
        none = F.array().cast("array<array<string>>").alias("groups")
        return requests.where("query <> ''").select(F.struct("query_id", T.lexemes(q).alias("exact"), none, *days, *FILTERS[1:], *wishes).alias("ask"))
    rows = requests.where("query <> ''").select(
        "query_id", T.lexemes(q).alias("exact"), *FILTERS, I.expanded_terms(q).alias("terms"),
        I.intent_days(q).alias("intent_days"), I.intent_experience(q).alias("intent_experience"), I.intent_split(q).alias("intent_split"),
    )
    rows = _with_groups(rows)
    days = [F.col(f).cast("long").alias(f) for f in ("days_per_week", "intent_days")]
    kept = [f for f in (*FILTERS, "intent_experience", "intent_split") if f != "days_per_week"]
    return rows.select(F.struct("query_id", "exact", "groups", *days, *kept).alias("ask"))


def shard_documents(c: Corpus) -> DataFrame:
    """(shard, doc): each document with its source's figures and its programs, stored with the corpus."""

    def build() -> DataFrame:
        programs = shelf(c).programs.groupBy("doc_id").agg(
            F.collect_list(F.struct(
                "program_id", F.col("confidence").cast("double").alias("confidence"), F.unix_micros("newest_crawl").alias("newest"),
                F.col("p_days_per_week").cast("long").alias("p_days_per_week"), *[f"p_{f}" for f in FILTERS[1:-1]],
            )).alias("programs")
        )
        docs = IX.placed_documents(c).withColumnRenamed("id", "doc_id").join(shelf_sources(c), "source_id").join(programs, "doc_id", "left")
        return docs.select("shard", F.struct("doc_id", "source_id", F.unix_micros("created_at").alias("created"), "page_quality", "source_domain", "sliced", "programs").alias("doc"))

    return c.keep(f"shards-{IX.shard_docs(c)}", build)


def stemmed_asks(asked: DataFrame) -> DataFrame:
    """Requests (ask) whose exact leg has the stems of all their tokens; a job over the distinct tokens asked for."""
    words = asked.select("ask.query_id", F.explode("ask.exact").alias("token"))
    known = stems(words.select("token").distinct())
    lists = words.join(known, "token").groupBy("query_id").agg(F.array_sort(F.collect_set("stem")).alias("stems"))
    rows = asked.withColumn("query_id", F.col("ask.query_id")).join(lists, "query_id")
    return rows.select(F.col("ask").withField("exact", F.col("stems")).withField("groups", F.array().cast("array<array<string>>")).alias("ask"))


def search_shards(
    requests: DataFrame, c: Corpus, *, exact: int = 0, expanded: int = 0, sources: int = 0, legs: tuple[str, ...] = (), proximity: bool = False, stemmed: bool = False,
) -> DataFrame:
    """The best rows of every shard for requests with text (``shards.FOUND``), or all matches of ``legs``.

    Where all terms are needed, a request goes only to the shards that have its
    rarest one; the expanded leg asks every shard. ``stemmed`` matches by the vocabulary's stems (all terms only), ``proximity``
    adds how near the terms of a matching document stand to each other.
    """
    requests = as_asked(requests)
    every = bool(expanded) or EXPANDED in legs
    asked = asks(requests, every)
    if stemmed:
        tokens = F.array_distinct(F.filter(T.tokens(F.col("query")), lambda t: ~T.is_stop_word(t)))
        raw = requests.select("query_id", tokens.alias("tokens"))
        asked = asked.withColumn("query_id", F.col("ask.query_id")).join(raw, "query_id").select(F.col("ask").withField("exact", F.col("tokens")).alias("ask"))
        asked = stemmed_asks(asked)
    asked = c.stage(asked, "asks")
    shards = IX.shard_count(c)
    terms = F.array_union("ask.exact", F.flatten("ask.groups")) if every else F.col("ask.exact")
    wanted = IX.wanted_postings(c, asked.select(F.explode(terms).alias("lexeme")), proximity, stemmed)
    if every:
        dealt = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "ask")
    else:
        dealt = routed(asked, wanted)
    tasks = 2 * c.spark.sparkContext.defaultParallelism
    if not every and not exact and not sources:
        # All matches are wanted, and each document's are its own: the work is dealt by document.
        shares = max(1, min(-(-tasks // shards), asked.count() // 1024))
        return SH.search_shards(*SH.divided(shards, shard_documents(c), wanted, dealt, shares), legs=legs, proximity=proximity)
    # Few shards are had by several tasks each, with a part of the requests: so many that they cost more than making the shard once more.
    shares = max(1, min(-(-tasks // shards), asked.count() // (4096 if every else 32_768)))
    return SH.search_shards(
        shards, shard_documents(c), wanted, dealt, exact=exact, expanded=expanded, sources=sources, legs=legs, proximity=proximity, shares=shares,
    )


#: Shards from which on they are searched in waves, and waves' growth: the first has one in so many, each further one as many as went before.
WAVE_SHARDS, WAVE_SHARE = 4, 8


def waves(shards: int) -> list[tuple[int, int]]:
    """The first shard of each wave, and the one behind its last."""
    if shards < WAVE_SHARDS:
        return [(0, shards)]
    ends = [-(-shards // WAVE_SHARE)]
    while ends[-1] < shards:
        ends.append(min(shards, 2 * ends[-1]))
    return list(zip([0, *ends], ends, strict=False))


def found_in_waves(requests: DataFrame, c: Corpus, *, expanded: int, exact: int = 0, sources: int = 0) -> DataFrame:
    """What ``search_shards`` finds, stored, without most rows of the expanded leg that other shards surpass.

    A wave of shards knows the last of the best ``expanded`` rows that the waves
    before have found for each request, its floor, and looks for no row below
    it. So a request's rows grow with the logarithm of the shards.
    """
    shards = IX.shard_count(c)
    if len(waves(shards)) == 1:
        return c.stage(search_shards(requests, c, exact=exact, expanded=expanded, sources=sources), "found")
    asked = c.stage(asks(as_asked(requests)), "asks")
    lexemes = c.stage(asked.select(F.explode(F.array_union("ask.exact", F.flatten("ask.groups"))).alias("lexeme")).distinct(), "lexemes")
    wanted, docs, n = IX.wanted_postings(c, lexemes), shard_documents(c), asked.count()
    tasks, best, parts = 2 * c.spark.sparkContext.defaultParallelism, None, []
    lead = (F.col("intent_score") * SH.LEAD + F.col("rank_millionths")).cast("int")

    def leading(lists: Column) -> Column:
        return F.slice(F.sort_array(lists, asc=False), 1, expanded)

    for low, high in waves(shards):
        floor = F.lit(None).cast("int")
        known = asked
        if best is not None:
            floor = F.get("best", F.lit(expanded - 1))
            known = asked.withColumn("query_id", F.col("ask.query_id")).join(best, "query_id", "left")
        known = known.select(F.col("ask").withField("floor", floor).alias("ask"))
        dealt = known.select(F.explode(F.sequence(F.lit(0), F.lit(high - low - 1))).alias("shard"), "ask")
        own = [
            df.where(F.col("shard").between(low, high - 1)).withColumn("shard", F.col("shard") - low) for df in (docs, wanted)
        ]
        shares = max(1, min(-(-tasks // (high - low)), n // 4096))
        parts.append(c.stage(SH.search_shards(high - low, *own, dealt, exact=exact, expanded=expanded, sources=sources, shares=shares), "found"))
        if high < shards:
            fresh = parts[-1].where(F.col("leg") == EXPANDED).groupBy("query_id").agg(leading(F.collect_list(lead)).alias("best"))
            if best is not None:
                fresh = best.unionByName(fresh).groupBy("query_id").agg(leading(F.flatten(F.collect_list("best"))).alias("best"))
            best = c.stage(fresh, "best")
    return reduce(DataFrame.unionByName, parts)


def routed(asked: DataFrame, wanted: DataFrame) -> DataFrame:
    """(shard, ask) for the shards that have the request's rarest term, by the number of shards that have it."""
    held = wanted.select(F.col("post.lexeme").alias("lexeme"), "shard")
    n = held.groupBy("lexeme").agg(F.count("*").alias("n"))
    # An id may come with several texts.
    own = asked.select("ask", F.col("ask.query_id").alias("query_id"), F.xxhash64("ask.exact").alias("text"))
    terms = own.select("query_id", "text", F.explode("ask.exact").alias("lexeme"))
    least = terms.join(n, "lexeme", "left").groupBy("query_id", "text").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "lexeme")).alias("least"))
    at = least.where("least.n > 0").select("query_id", "text", F.col("least.lexeme").alias("lexeme")).join(held, "lexeme")
    return own.join(at.select("query_id", "text", "shard"), ["query_id", "text"]).select("shard", "ask")


def _ranked(found: DataFrame, leg: str) -> DataFrame:
    return found.where(F.col("leg") == leg).withColumn("text_rank", F.round(F.col("rank_millionths") / 1e6, 6))


def match_documents(requests: DataFrame, c: Corpus, legs: tuple[str, ...] = (EXACT, EXPANDED)) -> DataFrame:
    """(query_id, leg, doc_id, text_rank) of every document a request matches.

    The exact leg needs every lexeme, the expanded leg any complete group. All
    rows are wanted here; searches ask their shards for the best ones only.
    """
    found = search_shards(requests, c, legs=legs)
    return found.select("query_id", "leg", "doc_id", F.round(F.col("rank_millionths") / 1e6, 6).alias("text_rank"))


def rank_proximity(requests: DataFrame, c: Corpus) -> DataFrame:
    """(query_id, doc_id, rank_proximity) of the documents that have all terms: how near the terms stand, by their positions.

    Each two places of two different terms, d words apart, count 0.1 * sqrt(1 / (1.005 + 0.05 * exp(d / 1.5 - 2)));
    places over 100 words apart count nothing. The rank is one minus the product of what they leave.
    A request of one term has nothing to compare and keeps its text rank.
    """
    found = search_shards(requests, c, proximity=True)
    return found.select("query_id", "doc_id", F.round("proximity", 6).alias("rank_proximity"))


def stem_matches(requests: DataFrame, c: Corpus) -> DataFrame:
    """(query_id, doc_id, text_rank) of the documents that have all terms by their vocabulary stems."""
    found = search_shards(requests, c, legs=(EXACT,), stemmed=True)
    return found.select("query_id", "doc_id", F.round(F.col("rank_millionths") / 1e6, 6).alias("text_rank"))


@dataclass
class Shelf:
    """The narrow columns retrieval sorts and filters by."""

    programs: DataFrame
    sources: DataFrame


def shelf(c: Corpus) -> Shelf:
    """Programs and sources as search needs them, stored with the corpus."""
    return Shelf(c.keep("shelf_programs", lambda: _shelf_programs(c)), shelf_sources(c))


def shelf_sources(c: Corpus) -> DataFrame:
    return c.keep("shelf_sources", lambda: _shelf_sources(c))


def _shelf_sources(c: Corpus) -> DataFrame:
    src = c.sources.select(
        F.col("id").alias("source_id"), "canonical_url", "domain_id",
        U.page_quality_score(F.col("canonical_url")).cast("long").alias("page_quality"),
    )
    dom = c.domains.select(F.col("id").alias("domain_id"), F.col("domain").alias("source_domain"))
    return src.join(dom, "domain_id").drop("domain_id")


def _shelf_programs(c: Corpus) -> DataFrame:
    src = shelf_sources(c)
    jobs = c.crawl_jobs.select(F.col("id").alias("crawl_job_id"), "started_at")
    docs = c.document_keys.select(
        F.col("id").alias("doc_id"), "source_id", "crawl_job_id", F.col("created_at").alias("doc_created")
    )
    docs = docs.join(jobs, "crawl_job_id", "left").drop("crawl_job_id")
    programs = c.programs.select(
        F.col("id").alias("program_id"), F.col("document_id").alias("doc_id"), "confidence",
        *[F.col(f).alias(f"p_{f}") for f in FILTERS[:-1]], "created_at",
    )
    programs = programs.join(docs, "doc_id").join(src, "source_id").withColumn(
        "newest_crawl", F.coalesce("started_at", "doc_created", "created_at")
    )
    return programs.drop("started_at", "doc_created", "created_at")


def _passes(filters=FILTERS) -> Column:
    out = F.lit(True)
    for f in filters:
        have = "source_domain" if f == "domain" else f"p_{f}"
        out = out & (F.col(f).isNull() | (F.col(f) == F.col(have)))
    return out


def structured_score() -> Column:
    """Number of active filters. All are also conditions, so it is the same in
    every result row of a request and never changes the order."""
    return sum((F.col(f).isNotNull().cast("long") for f in FILTERS), F.lit(0).cast("long"))


def exact_order() -> list[Column]:
    return [
        F.desc("structured_score"), F.desc("text_rank"), F.desc("page_quality"),
        F.desc_nulls_last("confidence"), F.desc_nulls_last("newest_crawl"), F.asc("program_id"),
    ]


def expanded_order() -> list[Column]:
    return [F.desc("intent_score"), F.desc("text_rank"), F.desc_nulls_last("confidence"), F.asc("program_id")]


def exact_programs(requests: DataFrame, found: DataFrame, limit: int) -> DataFrame:
    """Exact leg of text requests: the best ``limit`` of what the shards found, with ``rank``."""
    rows = _ranked(found, EXACT).withColumn("newest_crawl", F.timestamp_micros("newest_crawl"))
    rows = rows.join(requests.select("query_id", *FILTERS), "query_id").withColumn("structured_score", structured_score())
    return top_n(rows, ["query_id"], exact_order(), limit)


def browse_programs(requests: DataFrame, s: Shelf, limit: int) -> DataFrame:
    """Requests without text: filters only, no text rank.

    Programs meet requests by equality on the values of the active filters.
    Each program is looked up once per filter combination that occurs (64 at
    most), and each distinct filter set is answered once, however many requests
    share it.
    """
    blank = requests.where("query = ''")
    bits = [F.when(F.col(f).isNotNull(), 1 << i).otherwise(0) for i, f in enumerate(FILTERS)]
    mask = sum(bits[1:], bits[0])
    key = F.concat_ws("\x1f", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in FILTERS])
    blank = blank.withColumn("mask", mask).withColumn("filter_key", key)
    sets = blank.select("mask", "filter_key", *FILTERS).distinct()

    def value(i: int, f: str) -> Column:
        have = "source_domain" if f == "domain" else f"p_{f}"
        active = F.col("mask").bitwiseAND(F.lit(1 << i)) != 0
        return F.when(active, F.coalesce(F.col(have).cast("string"), F.lit("\x00"))).otherwise("")

    used = [r.mask for r in sets.select("mask").distinct().collect()]  # at most 64 numbers
    masks = F.explode(F.array(*[F.lit(m) for m in used]).cast("array<int>"))
    offered = s.programs.withColumn("mask", masks).withColumn(
        "filter_key", F.concat_ws("\x1f", *[value(i, f) for i, f in enumerate(FILTERS)])
    )
    rows = offered.join(sets, ["mask", "filter_key"])
    rows = rows.withColumn("structured_score", structured_score()).withColumn("text_rank", F.lit(0.0))
    best = top_n(rows, ["mask", "filter_key"], exact_order(), limit, spread=["program_id"])
    return best.join(blank.select("query_id", "mask", "filter_key"), ["mask", "filter_key"])


def expanded_programs(found: DataFrame, limit: int) -> DataFrame:
    """Expanded leg: hard filters stay, inferred constraints only score."""
    return top_n(_ranked(found, EXPANDED), ["query_id"], expanded_order(), limit)


def fill_depth(limit: int) -> int:
    """Rows of the expanded leg that are enough to fill ``limit`` after the exact ones are taken out."""
    return max(2 * limit, 25)


def search_programs(
    requests: DataFrame, c: Corpus, limit: int = 25, found: DataFrame | None = None
) -> DataFrame:
    """(query_id, rank, leg, program_id, doc_id, source_id, text_rank, confidence).

    Exact rows come first; expanded rows fill up to ``limit`` where text was
    given. Only narrow columns travel; text is joined to the result if needed.
    ``found`` may hold what the shards found for these requests, to this depth.
    """
    requests = as_asked(requests)
    if found is None:
        found = found_in_waves(requests, c, exact=limit, expanded=fill_depth(limit))
    s = shelf(c)
    keep = ["query_id", "program_id", "doc_id", "source_id", "text_rank", "confidence", "rank"]
    exact = exact_programs(requests, found, limit).select(*keep)
    browse = browse_programs(requests, s, limit).select(*keep)
    wider = expanded_programs(found, fill_depth(limit)).select(*keep)
    # At most limit and max(2 * limit, 25) rows per request meet here.
    fill = wider.join(exact.select("query_id", "program_id"), ["query_id", "program_id"], "left_anti")
    rows = (
        exact.unionByName(browse).withColumn("leg", F.lit(EXACT)).withColumn("leg_no", F.lit(0))
        .unionByName(fill.withColumn("leg", F.lit(EXPANDED)).withColumn("leg_no", F.lit(1)))
    ).withColumnRenamed("rank", "leg_rank")
    return top_n(rows, ["query_id"], [F.asc("leg_no"), F.asc("leg_rank")], limit).drop("leg_no", "leg_rank")


def source_order() -> list[Column]:
    return [
        F.desc("text_rank"), F.desc("page_quality"), F.desc_nulls_last("latest_document_at"), F.asc("source_id")
    ]


def search_sources(
    requests: DataFrame, c: Corpus, limit: int = 25, found: DataFrame | None = None
) -> DataFrame:
    """(query_id, rank, source_id, text_rank, page_quality, latest_document_at).

    A source comes from one shard, or from several if it is very large; then its
    best rank and newest match are united here.
    """
    requests = as_asked(requests)
    if found is None:
        found = search_shards(requests, c, sources=limit)
    docs = c.document_keys.select("source_id", "created_at")
    src = shelf_sources(c)
    rows = _ranked(found, SH.SOURCE).groupBy("query_id", "source_id").agg(
        F.max("text_rank").alias("text_rank"), F.max("page_quality").alias("page_quality"),
        F.timestamp_micros(F.max("latest_document_at")).alias("latest_document_at"),
    )
    by_text = top_n(rows, ["query_id"], source_order(), limit)

    # Requests without text see every source that has a document, at rank 0.
    # Each distinct domain filter (or none) is answered once.
    blank = requests.where("query = ''").select("query_id", F.coalesce("domain", F.lit("*")).alias("scope"))
    newest = docs.groupBy("source_id").agg(F.max("created_at").alias("latest_document_at"))
    known = src.join(newest, "source_id").withColumn("text_rank", F.lit(0.0))
    offered = known.withColumn("scope", F.explode(F.array("source_domain", F.lit("*"))))
    offered = offered.join(blank.select("scope").distinct(), "scope")
    best = top_n(offered, ["scope"], source_order(), limit, spread=["source_id"]).join(blank, "scope")
    return by_text.unionByName(best.select(*by_text.columns))
