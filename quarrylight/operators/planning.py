"""Runnable domains, crawl plans, active crawls and dry runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions import fixed_values as V
from quarrylight.functions import urls as U
from quarrylight.operators.groups import top_n, top_n_by
from quarrylight.operators.normalize import resolve_attempts
from quarrylight.sources.corpus import Corpus


def runnable_domains(requested: DataFrame, domains: DataFrame) -> DataFrame:
    """(pos, domain, reason) of each requested(pos, name); reason NULL = runnable."""
    asked = requested.select("pos", F.lower(F.trim("name")).alias("domain")).where("domain <> ''")
    rows = asked.join(domains.select("domain", "id", "allowlisted", "paused"), "domain", "left")
    reason = (
        F.when(F.col("id").isNull(), "domain_not_found").when(~F.col("allowlisted"), "domain_not_allowlisted")
        .when(F.col("paused"), "domain_paused")
    )
    return rows.select("pos", "domain", F.col("id").alias("domain_id"), reason.alias("reason"))


def empty_sources(c: Corpus) -> DataFrame:
    """Succeeded sources whose latest document has no program."""
    done = c.sources.where("status = 'succeeded' AND latest_document_id IS NOT NULL")
    have = c.programs.select(F.col("document_id").alias("latest_document_id"))
    return done.join(have, "latest_document_id", "left_anti").select("id", "domain_id", "canonical_url")


def reextract_queue(c: Corpus, limit: int = V.REEXTRACT_LIMIT) -> DataFrame:
    """(domain, source_id) of a re-extract batch: the first ``limit`` empty sources of each domain without an active crawl."""
    busy = active_crawls(c).select("domain")
    free = c.domains.join(busy, "domain", "left_anti").select(F.col("id").alias("domain_id"), "domain")
    rows = empty_sources(c).join(free, "domain_id")
    return top_n(rows, ["domain"], [F.asc("id")], max(1, limit), spread=["id"]).select("domain", F.col("id").alias("source_id"))


def reextract_results(queue: DataFrame, jobs: DataFrame, made: DataFrame, max_retries: int = V.MAX_RETRIES) -> DataFrame:
    """What came of each queued source: (domain, source_id, status, document_id, error).

    jobs(id, source_id, message, error_type, invalid) are extraction jobs, a source's
    first ones by id its attempts; made(source_id, document_id) the documents
    that the batch wrote. A source whose attempts have not ended is ``queued``.
    """
    wanted = jobs.join(queue.select("source_id"), "source_id", "left_semi")
    first = top_n(wanted, ["source_id"], [F.asc("id")], max_retries + 1, "no", spread=["id"])
    states = resolve_attempts(first.select(
        F.col("source_id").alias("job_id"), (F.col("no") - 1).alias("attempt"), F.lit("extract").alias("job_type"), "message", "error_type", "invalid"
    ), max_retries).where("status <> 'running'").select(F.col("job_id").alias("source_id"), "status", F.col("error_message").alias("error"))
    rows = queue.join(states, "source_id", "left").join(made.select("source_id", "document_id"), "source_id", "left")
    return rows.select(
        "domain", "source_id", F.coalesce("status", F.lit("queued")).alias("status"),
        F.when(F.col("status") == "succeeded", F.col("document_id")).alias("document_id"), "error",
    )


def reextract_outcome(domains: DataFrame, active: DataFrame, results: DataFrame) -> DataFrame:
    """Queued, processed, succeeded and failed sources of each domain, and the crawl that blocks its batch."""
    s = F.col("status")
    counts = results.groupBy("domain").agg(
        F.count("*").alias("queued"), F.count_if(s != "queued").alias("processed"),
        F.count_if(s == "succeeded").alias("succeeded"), F.count_if(s == "failed").alias("failed"),
    )
    rows = domains.select("domain").join(active.select("domain", F.col("crawl_id").alias("blocked_by")), "domain", "left").join(counts, "domain", "left")
    return rows.select("domain", "blocked_by", *[F.coalesce(k, F.lit(0)).alias(k) for k in ("queued", "processed", "succeeded", "failed")])


def plan_candidates(c: Corpus, domains: DataFrame) -> DataFrame:
    """Planned sources of domains(domain_id, domain, cap), before the global cap.

    Pending sources come first, then empty ones, each by id.
    """
    pending = c.sources.where("status = 'pending'").select("id", "domain_id", "canonical_url", F.lit("extract_pending").alias("mode"))
    rows = pending.unionByName(empty_sources(c).withColumn("mode", F.lit("refresh_empty"))).join(domains, "domain_id")
    return top_n_by(rows, ["domain_id"], [F.asc("mode"), F.asc("id")], F.col("cap"), ["id"], rank="place").drop("cap")


def spend_budget(planned: DataFrame, order: str, budget: int) -> DataFrame:
    """Cut planned sources to a global budget, domain after domain.

    Each domain that plans anything uses at least one unit, so only the first
    ``budget`` such domains can matter: the running total is over those few.
    """
    sizes = planned.groupBy(order).agg(F.count("*").alias("n")).orderBy(order).limit(budget)
    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    left = sizes.withColumn("used", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("used") < budget)
    rows = planned.join(F.broadcast(left.select(order, "used")), order)  # at most `budget` rows
    return rows.where(F.col("place") + F.col("used") <= budget).withColumn("seq", F.col("used") + F.col("place")).drop("used")


def _caps(domains: DataFrame, policies: DataFrame, per_domain: int, budget: int) -> DataFrame:
    """Add the ``cap`` of each domain: its policy's limit, else the default."""
    limits = policies.select("domain", F.col("per_domain_limit").alias("own"))
    own = F.when(F.col("own").isNotNull(), F.greatest(F.lit(1), "own")).otherwise(F.lit(per_domain))
    return domains.join(limits, "domain", "left").withColumn("cap", F.least(own, F.lit(budget))).drop("own")


def crawl_plan(
    c: Corpus, domains: DataFrame, policies: DataFrame, per_domain: int = V.PER_DOMAIN_LIMIT, budget: int = V.GLOBAL_LIMIT
) -> DataFrame:
    """Plan of the given domains(domain_id, domain), in name order."""
    caps = _caps(domains, policies, per_domain, budget)
    return spend_budget(plan_candidates(c, caps), "domain", budget)


def active_crawls(c: Corpus) -> DataFrame:
    """The active crawl of each domain: its newest open source-linked job, else
    the newest open discovery whose target host lies in the domain."""
    open_ = c.crawl_jobs.where("status IN ('pending', 'running')").select("id", "source_id", "target_url", "status", "started_at")
    src = c.sources.select(F.col("id").alias("source_id"), "domain_id")
    dom = c.domains.select(F.col("id").alias("domain_id"), "domain")
    linked = open_.where("source_id IS NOT NULL").join(src, "source_id").join(dom, "domain_id").withColumn("kind", F.lit(1))
    hosts = open_.where("source_id IS NULL").withColumn("domain", F.explode(U.host_suffixes(U.netloc(F.col("target_url")))))
    loose = hosts.join(dom, "domain").withColumn("kind", F.lit(0))
    cols = ["domain", "kind", "id", "status", "started_at"]
    both = linked.select(*cols).unionByName(loose.select(*cols))
    order = F.struct("kind", F.col("started_at").isNull(), "started_at", "id")
    return both.groupBy("domain").agg(F.max_by(F.struct("id", "status"), order).alias("job")).select(
        "domain", F.col("job.id").alias("crawl_id"), F.col("job.status").alias("crawl_status")
    )


def seed_urls(domains: DataFrame, policies: DataFrame, entries: list[str]) -> DataFrame:
    """Seeds of each domain: option entries, then its policy, without repeats.

    ``entries`` is a short option list: ``url`` for all, ``domain=url`` for one.
    """
    options = []
    for entry in (e.strip() for e in entries):
        if "=" in entry:
            left, right = entry.split("=", 1)
            if right.strip():
                options.append(F.when(F.col("domain") == left.strip().lower(), F.lit(right.strip())))
        elif entry:
            options.append(F.lit(entry))
    given = F.array_compact(F.array(*options)) if options else F.array().cast("array<string>")
    extra = F.transform(F.coalesce("seed_urls", F.array().cast("array<string>")), lambda s: F.trim(s))
    rows = domains.select("domain").join(policies.select("domain", "seed_urls"), "domain", "left")
    return rows.select("domain", F.array_distinct(F.filter(F.concat(given, extra), lambda s: s != "")).alias("seeds"))


def dry_run_items(
    c: Corpus, requested: DataFrame, policies: DataFrame, decided: DataFrame, entries: list[str],
    per_domain: int = V.PER_DOMAIN_LIMIT, budget: int = V.GLOBAL_LIMIT,
) -> DataFrame:
    """The items a dry run would log, domain after domain in request order.

    A domain passes the admission gate and the active-crawl gate, then its
    discovery and its plan are listed as skipped. Domains after the one that
    uses up the budget leave no item.
    """
    asked = runnable_domains(requested, c.domains)
    gates = decided.select("domain", "admission_block_reason")
    run = asked.where("reason IS NULL").select("pos", "domain", "domain_id").join(gates, "domain")
    run = run.join(active_crawls(c), "domain", "left").join(seed_urls(c.domains, policies, entries), "domain", "left")
    free = run.where("admission_block_reason IS NULL AND crawl_id IS NULL")

    caps = _caps(free.select("domain_id", "domain", "pos"), policies, per_domain, budget)
    plan = spend_budget(plan_candidates(c, caps), "pos", budget)
    # The budget ends with the domain of its last unit, if it is used up.
    last = plan.agg(F.when(F.count("*") >= budget, F.max("pos")).alias("last_pos")).scalar()

    text = "string"
    none = F.lit(None)
    cols = ("item_type", "mode", "domain", "source_id", "status", "error_code", "error_kind", "crawl_id")

    def items(df: DataFrame, kind, status, code, error_kind, source=none, mode=none, crawl=none) -> DataFrame:
        values = (kind, mode.cast(text), F.col("domain"), source.cast("long"), status, code, error_kind, crawl.cast("long"))
        return df.select(*[v.alias(n) for n, v in zip(cols, values)])

    gate, blocked = F.lit("domain_gate"), F.lit("blocked")
    reached = run.withColumn("last_pos", last).where("last_pos IS NULL OR pos <= last_pos").drop("last_pos")
    refused = items(asked.where("reason IS NOT NULL"), gate, blocked, F.concat(F.lit("blocked_"), "reason"), blocked)
    poor = items(reached.where("admission_block_reason IS NOT NULL"), gate, blocked, F.concat(F.lit("blocked_"), "admission_block_reason"), blocked)
    busy = items(
        reached.where("admission_block_reason IS NULL AND crawl_id IS NOT NULL"), gate, blocked, F.lit("blocked_active_crawl"),
        blocked, crawl=F.col("crawl_id"),
    )
    found = F.when(F.size("seeds") > 0, "dry_run").otherwise("no_seed_urls")
    discover = items(
        reached.where("admission_block_reason IS NULL AND crawl_id IS NULL"), F.lit("discover"), F.lit("skipped"), found, F.lit("terminal")
    )
    sources = items(plan, F.col("mode"), F.lit("skipped"), F.lit("dry_run"), F.lit("terminal"), F.col("id"), F.col("mode"))
    return refused.unionByName(poor).unionByName(busy).unionByName(discover).unionByName(sources)
