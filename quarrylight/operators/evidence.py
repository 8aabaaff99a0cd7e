"""Evidence selection and deterministic answers for a batch of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions import fixed_values as V
from quarrylight.functions import text as T
from quarrylight.functions import urls as U
from quarrylight.operators import retrieve as R
from quarrylight.sources.corpus import Corpus

# Request bounds of the service.
MAX_SOURCES, MAX_PROGRAMS, MAX_QUERY = 50, 100, 400
MAX_EVIDENCE = 25
DOMAIN_PATTERN = r"^(?=.{1,253}$)(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,63}$"


def validate_requests(requests: DataFrame) -> DataFrame:
    """Add the cleaned query and domain, ``accepted`` and ``reject_reason``."""
    query = T.strip(F.col("query"))
    domain = F.nullif(F.lower(T.strip(F.col("domain"))), F.lit(""))
    size = F.length("query")
    reason = (
        F.when(F.col("query").isNull() | (size < 1) | (query == ""), "query_must_not_be_blank")
        .when(size > MAX_QUERY, "query_too_long")
        .when(~F.col("max_sources").between(1, MAX_SOURCES), "max_sources_out_of_range")
        .when(~F.col("max_programs").between(1, MAX_PROGRAMS), "max_programs_out_of_range")
        .when(~F.col("max_evidence").between(1, MAX_EVIDENCE), "max_evidence_out_of_range")
        .when(domain.isNotNull() & ~domain.rlike(DOMAIN_PATTERN), "invalid_domain_filter")
    )
    return requests.withColumn("query", query).withColumn("domain", domain).withColumn(
        "reject_reason", reason
    ).withColumn("accepted", F.col("reject_reason").isNull())


def ranked_lists(requests: DataFrame, c: Corpus) -> tuple[DataFrame, DataFrame]:
    """Ranked programs and sources of each request, cut to its own limits."""
    limits = requests.select("query_id", "max_sources", "max_programs")
    # Two numbers of the batch, so no request is clipped; ``validate_requests`` rejects those that ask for too much.
    most = limits.agg(F.max("max_sources").alias("sources"), F.max("max_programs").alias("programs")).first()
    n_programs, n_sources = most["programs"] or 1, most["sources"] or 1
    found = R.found_in_waves(requests, c, exact=n_programs, expanded=R.fill_depth(n_programs), sources=n_sources)
    programs = R.search_programs(requests, c, n_programs, found).join(limits, "query_id").where("rank <= max_programs")
    sources = R.search_sources(requests, c, n_sources, found).join(limits, "query_id").where("rank <= max_sources")
    return c.stage(programs, "programs"), c.stage(sources, "sources")


def program_evidence(programs: DataFrame) -> DataFrame:
    """The first half of the evidence: cut first, then one card per document."""
    head = programs.where((F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("max_sources") / 2))) & F.col("source_id").isNotNull())
    return head.groupBy("query_id", "source_id", "doc_id").agg(
        F.min(F.struct("rank", "program_id", "confidence")).alias("best")
    ).select("query_id", "source_id", F.col("doc_id").alias("document_id"), "best.*")


def select_evidence(programs: DataFrame, sources: DataFrame, c: Corpus) -> DataFrame:
    """(query_id, rank, source_id, document_id, reason, program_id, confidence).

    At most 25 program rows and 50 source rows per request arrive here.
    """
    first = program_evidence(programs)
    latest = c.sources.select(F.col("id").alias("source_id"), F.coalesce("latest_document_id", F.lit(0)).alias("document_id"))
    rest = sources.join(latest, "source_id").join(
        first.select("query_id", "source_id", "document_id"), ["query_id", "source_id", "document_id"], "left_anti"
    )
    cards = first.select(
        "query_id", "source_id", "document_id", F.lit("program_match").alias("reason"), "program_id", "confidence",
        F.lit(0).alias("part"), "rank",
    ).unionByName(
        rest.select(
            "query_id", "source_id", "document_id", F.lit("source_fallback").alias("reason"),
            F.lit(None).cast("long").alias("program_id"), F.lit(None).cast("double").alias("confidence"),
            F.lit(1).alias("part"), "rank",
        )
    )
    return cards.withColumnRenamed("rank", "part_rank")


def cut_evidence(picked: DataFrame, asked: DataFrame) -> DataFrame:
    """Selected evidence in its order, cut to ``max_sources`` of each request."""
    w = Window.partitionBy("query_id").orderBy("part", "part_rank")
    return picked.withColumn("rank", F.row_number().over(w).cast("long")).join(asked, "query_id").where("rank <= max_sources")


def evidence_cards(requests: DataFrame, c: Corpus, lists: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Complete cards: selection, then texts and dates joined to what was kept."""
    programs, sources = lists or ranked_lists(requests, c)
    kept = cut_evidence(select_evidence(programs, sources, c), requests.select("query_id", F.coalesce("query", F.lit("")).alias("query"), "max_sources"))

    src = c.sources.select(
        F.col("id").alias("source_id"), "canonical_url", F.col("title").alias("source_title"), "last_crawled_at", "domain_id"
    ).join(c.domains.select(F.col("id").alias("domain_id"), F.col("domain").alias("source_domain")), "domain_id")
    names = c.programs.select(F.col("id").alias("program_id"), F.col("name").alias("program_name"))
    docs = c.documents.select(F.col("id").alias("document_id"), "published_at", "parse_confidence")
    rows = kept.join(src, "source_id").join(names, "program_id", "left").join(docs, "document_id", "left")
    # Texts of kept documents only: each is cleaned once, however many requests show it.
    texts = c.document_texts.withColumnRenamed("raw_text", "text")
    snippets = T.snippets(kept.select(F.col("document_id").alias("id"), "query"), texts).withColumnRenamed("id", "document_id")
    rows = rows.join(snippets, ["document_id", "query"], "left")
    is_program = F.col("reason") == "program_match"
    return rows.select(
        "query_id", "rank", "source_id", "document_id", "reason", "canonical_url",
        F.when(is_program, F.col("program_name")).otherwise(F.col("source_title")).alias("title"),
        "snippet",
        F.when(is_program, F.col("confidence")).otherwise(F.col("parse_confidence")).alias("parse_confidence"),
        "last_crawled_at",
        F.when(is_program, U.domain_of_url(F.col("canonical_url"))).otherwise(F.col("source_domain")).alias("domain"),
        "source_title", "published_at",
    )


def retrieval_status(requests: DataFrame, cards: DataFrame) -> DataFrame:
    n = cards.groupBy("query_id").agg(F.count("*").alias("evidence"))
    rows = requests.select("query_id", "query").join(n, "query_id", "left")
    count = F.coalesce("evidence", F.lit(0))
    return rows.select(
        "query_id", F.when(count > 0, "ok").otherwise("insufficient_evidence").alias("status"),
        F.when(count == 0, 0.0).alias("confidence"), count.alias("evidence_selected"),
        F.when(count == 0, V.INSUFFICIENT_TEXT).otherwise(F.format_string(
            "Retrieved %d evidence items for query '%s'. Use evidence cards for grounded synthesis.", count, F.col("query")
        )).alias("answer"),
    )


def _listed(cards: DataFrame, ids: Column, name: str) -> DataFrame:
    """One ordered, comma-separated id list per request (bounded by its limit)."""
    return cards.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", ids.alias("v")))), lambda s: s["v"].cast("string")), ",").alias(name),
        F.count("*").alias(f"n_{name}"),
    )


def retrieval_debug(requests: DataFrame, programs: DataFrame, sources: DataFrame, cards: DataFrame) -> DataFrame:
    out = requests.select("query_id", "query")
    for rows, column, name in (
        (sources, "source_id", "source_candidates"), (programs, "program_id", "program_candidates"),
        (cards, "source_id", "evidence"),
    ):
        out = out.join(_listed(rows, F.col(column), name), "query_id", "left")
    names = ("source_candidates", "program_candidates", "evidence")
    return out.select(
        "query_id", "query", *[F.coalesce(n, F.lit("")).alias(n) for n in names],
        *[F.coalesce(f"n_{n}", F.lit(0)).alias(f"n_{n}") for n in names], F.lit("baseline").alias("retrieval_mode"),
    )


def answers(requests: DataFrame, cards: DataFrame) -> DataFrame:
    """Template answers from the first ``max_evidence`` cards of each request."""
    used = cards.join(requests.select("query_id", "max_evidence"), "query_id").where("rank <= max_evidence")
    url_domain = F.when(F.col("canonical_url") != "", U.domain_of_url(F.col("canonical_url")))

    domains = used.withColumn("d", url_domain).where("d IS NOT NULL").groupBy("query_id", "d").agg(
        F.count("*").alias("n"), F.min("rank").alias("at")
    )
    top = domains.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "at", "d"))).alias("ds")
    ).select("query_id", F.array_join(F.transform(F.slice("ds", 1, 3), lambda s: s["d"]), ", ").alias("top_domains"))

    def in_order(c: str) -> Column:
        have = F.when(F.col(c) != "", F.struct("rank", F.col(c).alias("v")))
        return F.transform(F.array_sort(F.collect_list(have)), lambda s: s["v"])

    per = used.groupBy("query_id").agg(
        F.count("*").alias("n"), F.slice(in_order("title"), 1, 5).alias("titles"),
        F.slice(in_order("snippet"), 1, 3).alias("snippets"), F.round(F.avg("parse_confidence"), 10).alias("confidence"),
    ).join(top, "query_id", "left")
    rows = requests.select("query_id", "query").join(per, "query_id", "left")
    lines = F.concat_ws(
        " ",
        F.concat(F.lit("For '"), F.col("query"), F.lit("', here are the strongest grounded takeaways from the indexed coaching corpus.")),
        F.concat(F.lit("Found "), F.col("n"), F.lit(" grounded evidence items.")),
        F.when(F.size("titles") > 0, F.concat(F.lit("Most relevant programs and sources: "), F.array_join("titles", ", "), F.lit("."))),
        F.when(F.size("snippets") > 0, F.concat(
            F.lit("Key practical cues from source text: - "), F.array_join("snippets", " - "))),
        F.when(F.col("top_domains").isNotNull(), F.concat(F.lit("Strongest supporting domains: "), F.col("top_domains"), F.lit("."))),
        F.when(F.col("confidence") < 0.65, F.lit("Evidence quality is limited, so treat these findings as directional rather than conclusive."))
        .when(F.col("n") < 2, F.lit("Only one supporting source was found, so this answer carries meaningful uncertainty.")),
        F.lit("Use evidence cards below for transparent source-level verification."),
    )
    none = F.col("n").isNull()
    return rows.select(
        "query_id", F.when(none, "insufficient_evidence").otherwise("ok").alias("status"),
        F.when(none, 0.0).otherwise(F.col("confidence")).alias("confidence"), F.coalesce("n", F.lit(0)).alias("n_evidence"),
        F.when(none, V.INSUFFICIENT_TEXT).otherwise(lines).alias("answer"),
    )


def displayed(cards: DataFrame) -> DataFrame:
    """Cards as shown: the first per URL, with a label for its quality."""
    key = F.coalesce(F.nullif("canonical_url", F.lit("")), F.concat_ws(":", "source_id", "document_id"))
    first = cards.withColumn("key", key).groupBy("query_id", "key").agg(F.min("rank").alias("rank"))
    rows = cards.withColumn("key", key).join(first, ["query_id", "key", "rank"], "left_semi")
    conf = F.col("parse_confidence")
    label = (
        F.when(conf.isNull(), "Quality not rated").when(conf >= 0.85, "High source quality")
        .when(conf >= 0.65, "Moderate source quality").otherwise("Limited source quality")
    )
    empty = F.lit("")
    return rows.select(
        "query_id", "rank", "canonical_url", F.coalesce(F.nullif("domain", empty), U.domain_of_url(F.col("canonical_url"))).alias("domain"),
        F.coalesce(F.nullif("source_title", empty), F.nullif("title", empty), F.lit("Supporting source")).alias("title"),
        "snippet", label.alias("quality"), F.coalesce("published_at", "last_crawled_at").alias("reviewed_at"),
    )
