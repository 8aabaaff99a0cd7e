"""Candidate URLs: extraction, domain match, policy and new sources."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quarrylight.functions import fixed_values as V
from quarrylight.functions import payload as P
from quarrylight.functions import text as T
from quarrylight.functions import urls as U
from quarrylight.operators.groups import top_n

_URL = r"""(https?://[^\s"'<>]+)"""


def _looks_like_json(s: Column) -> Column:
    return T.strip(s).rlike(r"^[{\[]")


def _unwrap(v: Column) -> Column:
    """A string that holds a JSON list or object counts as that value."""
    s = F.try_variant_get(v, "$", "string")
    parsed = F.when((P.kind(v) == "STRING") & _looks_like_json(s), F.try_parse_json(T.strip(s)))
    return F.coalesce(parsed, v)


def _children(v: Column) -> Column:
    named = F.array_compact(F.array(*[P.field(v, k) for k in V.URL_LIST_KEYS]))
    return (
        F.when(P.kind(v) == "ARRAY", F.try_variant_get(v, "$", "array<variant>"))
        .when(P.kind(v) == "OBJECT", named)
        .otherwise(F.array(v))
    )


#: Levels that are taken apart by built-in expressions; what lies deeper is walked with a stack.
_FLAT_LEVELS = 4


@F.arrow_udf(ArrayType(StringType()))
def _deep_urls(outputs: pa.Array) -> pa.Array:
    """URLs of JSON outputs nested to any depth, in reading order; null for null."""
    found_url = re.compile(_URL)

    def parsed(text: str):
        # A value too deep for the parser is read as text.
        try:
            return json.loads(text) if text.strip()[:1] in ("{", "[") else None
        except (ValueError, RecursionError):
            return None

    def urls(text: str) -> list[str]:
        found, rest = [], [text]
        while rest:
            value = rest.pop()
            if isinstance(value, list):
                rest.extend(reversed(value))
            elif isinstance(value, dict):
                rest.extend(value[k] for k in reversed(V.URL_LIST_KEYS) if k in value)
            elif isinstance(value, str):
                inner = parsed(value)
                if inner is None:
                    found += found_url.findall(value)
                else:
                    rest.append(inner)
        return found

    return pa.array([None if x is None else urls(x) for x in outputs.to_pylist()], pa.list_(pa.string()))


def found_urls(output: Column) -> Column:
    """All URLs of an output in reading order: list, object (urls,
    candidate_urls, links), JSON text or plain text, nested to any depth."""
    top = F.when(_looks_like_json(output), F.try_parse_json(T.strip(output)))
    nodes = F.array(top)
    for _ in range(_FLAT_LEVELS):
        nodes = F.flatten(F.transform(nodes, lambda n: F.transform(_children(n), _unwrap)))
    texts = F.filter(nodes, lambda n: P.kind(n) == "STRING")
    nested = F.flatten(
        F.transform(texts, lambda n: F.regexp_extract_all(F.try_variant_get(n, "$", "string"), F.lit(_URL), F.lit(1)))
    )
    deeper = F.exists(nodes, lambda n: P.kind(n).isin("ARRAY", "OBJECT"))
    deep = _deep_urls(F.when(top.isNotNull() & deeper, output))
    return (
        F.when(top.isNull(), F.regexp_extract_all(output, F.lit(_URL), F.lit(1)))
        .when(deep.isNotNull(), deep).otherwise(nested)
    )


def extract_candidates(outputs: DataFrame, key: str) -> DataFrame:
    """(key, pos, canonical_url): canonical, without repeats, in order. A map."""
    urls = F.transform(found_urls(F.col("output")), U.safe_canonicalize_url)
    once = F.array_distinct(F.array_compact(urls))
    return outputs.select(key, F.posexplode(once).alias("pos", "canonical_url"))


def match_domains(urls: DataFrame, domains: DataFrame) -> DataFrame:
    """Join urls(host) to each known domain that is the host or a parent of it.

    The host is split into its suffixes so that the join is on equality.
    """
    return urls.withColumn("domain", F.explode(U.host_suffixes(F.col("host")))).join(
        domains.select("domain"), "domain", "left_semi"
    )


def apply_cap(candidates: DataFrame, cap: int = V.MAX_CANDIDATES) -> DataFrame:
    """Mark the first ``cap`` allowed candidates of each domain as accepted.

    Everything else is rejected, so acceptance is a top-n of the allowed rows
    and no running count over a whole domain is needed.
    """
    allowed = candidates.where("allowed")
    best = top_n(allowed, ["domain"], [F.asc("seq")], max(1, cap)).select("seq", F.lit(True).alias("accepted"))
    return candidates.join(best, "seq", "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))


def create_sources(batch: DataFrame, domains: DataFrame, sources: DataFrame) -> DataFrame:
    """Outcome of each candidate in batch(seq, domain, raw_url).

    ``created`` goes to the first usable occurrence of an unknown URL. The
    first occurrence is a minimum per URL, a hash aggregate that combines on
    the map side, so many copies of one URL do not meet in one task.
    """
    known_domains = domains.select(F.col("domain"), F.lit(True).alias("has_domain"))
    known = sources.select("canonical_url", F.lit(True).alias("known"))
    rows = batch.withColumn("canonical_url", U.safe_canonicalize_url(F.col("raw_url")))
    rows = rows.join(known_domains, "domain", "left").join(known, "canonical_url", "left")
    host = U.netloc(F.col("canonical_url"))
    inside = (host == F.lower("domain")) | host.endswith(F.concat(F.lit("."), F.lower("domain")))
    rows = rows.withColumn(
        "reason",
        F.when(F.col("has_domain").isNull(), "domain_not_found").when(F.col("canonical_url").isNull(), "invalid_url")
        .when(~inside, "off_domain").when(F.col("known"), "duplicate"),
    )
    first = rows.where("reason IS NULL").groupBy("canonical_url").agg(F.min("seq").alias("first_seq"))
    out = rows.join(first, "canonical_url", "left")
    outcome = F.coalesce("reason", F.when(F.col("seq") == F.col("first_seq"), "created").otherwise("duplicate"))
    return out.select("seq", "domain", "raw_url", "canonical_url", outcome.alias("outcome"))


def new_source_rows(outcomes: DataFrame, domains: DataFrame) -> DataFrame:
    """The rows to append to sources; ids are hashes, so no counter is shared."""
    made = outcomes.where("outcome = 'created'")
    return made.join(domains.select("domain", F.col("id").alias("domain_id")), "domain").select(
        F.xxhash64("canonical_url").alias("id"), F.col("canonical_url").alias("url"), "canonical_url", "domain_id",
        F.lit("pending").alias("status"),
    )


def discover_candidates(jobs: DataFrame, cap: int = V.MAX_CANDIDATES) -> DataFrame:
    """Each candidate of jobs(job_id, domain, output): (job_id, domain, pos, canonical_url, verdict).

    A verdict is ``off_domain``, ``rejected`` by the policy or by the cap of
    the job, or ``accepted``. A job's candidates come from its own row, in
    reading order, so the cap is taken there: all of it is a map.
    """
    def entry(url: Column, i: Column) -> Column:
        host, domain = U.netloc(url), F.lower("domain")
        inside = (host == domain) | host.endswith(F.concat(F.lit("."), domain))
        return F.struct(
            i.cast("long").alias("pos"), url.alias("canonical_url"), F.coalesce(inside, F.lit(False)).alias("inside"),
            F.coalesce(U.is_allowed_candidate(url), F.lit(False)).alias("allowed"),
        )

    urls = F.array_distinct(F.array_compact(F.transform(found_urls(F.col("output")), U.safe_canonicalize_url)))
    rows = jobs.select("job_id", "domain", urls.alias("urls")).withColumn("entries", F.transform("urls", entry))
    usable = F.filter("entries", lambda e: e["inside"] & e["allowed"])
    last = F.try_element_at(usable, F.lit(max(1, cap)))["pos"]
    rows = rows.select("job_id", "domain", last.alias("last"), F.explode("entries").alias("e"))
    fits = F.col("e.allowed") & (F.col("last").isNull() | (F.col("e.pos") <= F.col("last")))
    verdict = F.when(~F.col("e.inside"), "off_domain").when(fits, "accepted").otherwise("rejected")
    return rows.select("job_id", "domain", F.col("e.pos").alias("pos"), F.col("e.canonical_url").alias("canonical_url"), verdict.alias("verdict"))


def discover_batch(jobs: DataFrame, states: DataFrame, domains: DataFrame, sources: DataFrame, cap: int = V.MAX_CANDIDATES) -> DataFrame:
    """Outcome of each candidate of the jobs that succeeded by states(job_id, status).

    Jobs count as run one after the other by id: an accepted URL that no
    source has goes to the first job and place that names it (``created``), a
    minimum per URL that combines on the map side. Other accepted ones are
    skipped as ``duplicate`` or ``domain_not_found``. With the columns of
    :func:`discover_candidates`; :func:`new_source_rows` reads it.
    """
    done = jobs.join(states.where("status = 'succeeded'").select("job_id"), "job_id", "left_semi")
    rows = discover_candidates(done, cap)
    taken = rows.where("verdict = 'accepted'").join(domains.select("domain"), "domain", "left_semi")
    first = taken.groupBy("canonical_url").agg(F.min(F.struct("job_id", "pos")).alias("first"))
    first = first.join(sources.select("canonical_url"), "canonical_url", "left_anti")
    named = domains.select("domain", F.lit(True).alias("has_domain"))
    rows = rows.join(named, "domain", "left").join(first, "canonical_url", "left")
    outcome = (
        F.when(F.col("verdict") != "accepted", F.col("verdict")).when(F.col("has_domain").isNull(), "domain_not_found")
        .when(F.struct("job_id", "pos") == F.col("first"), "created").otherwise("duplicate")
    )
    return rows.select("job_id", "domain", "pos", "canonical_url", outcome.alias("outcome"))


def discover_results(jobs: DataFrame, states: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Each job with its state (``pending`` before its first attempt) and the number of its candidates by outcome."""
    kinds = {
        "accepted": ("created", "duplicate", "domain_not_found"), "created": ("created",),
        "skipped": ("duplicate", "domain_not_found", "rejected"), "off_domain": ("off_domain",),
    }
    counts = outcomes.groupBy("job_id").agg(*[F.count_if(F.col("outcome").isin(*v)).alias(k) for k, v in kinds.items()])
    rows = jobs.select("job_id", "domain").join(states, "job_id", "left").join(counts, "job_id", "left")
    return rows.select(
        "job_id", "domain", F.coalesce("status", F.lit("pending")).alias("status"), F.coalesce("retry_count", F.lit(0)).cast("long").alias("retry_count"),
        "error_message", *[F.coalesce(k, F.lit(0)).alias(k) for k in kinds],
    )
