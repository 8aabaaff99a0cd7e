"""Domain crawl policies from JSON documents keyed by domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import payload as P
from quarrylight.functions import text as T

INT_FIELDS = ("per_domain_limit", "stale_after_days", "admission_min_succeeded_sources", "admission_recent_crawl_window")
RATE_FIELDS = (
    "admission_max_recent_failure_rate", "admission_min_avg_parse_confidence", "admission_max_zero_program_rate",
)
THRESHOLDS = (
    "admission_min_succeeded_sources", "admission_max_recent_failure_rate", "admission_min_avg_parse_confidence",
    "admission_max_zero_program_rate",
)


def load_policies(files: DataFrame) -> DataFrame:
    """One row per domain from files(body): an object of domain -> settings.

    Entries that are not objects are skipped, seeds that are not strings are
    dropped, numbers are cast.
    """
    v = F.try_parse_json("body")
    entries = F.try_variant_get(v, "$", "map<string, variant>")
    rows = files.select(F.explode(entries).alias("name", "v")).where(P.kind(F.col("v")) == "OBJECT")
    v = F.col("v")
    seeds = F.transform(
        F.filter(P.items(v, "seed_urls"), lambda s: P.kind(s) == "STRING"), lambda s: F.try_variant_get(s, "$", "string")
    )

    def number(name: str) -> Column:
        return F.try_variant_get(v, f"$.{name}", "double")

    return rows.select(
        F.lower(T.strip(F.col("name"))).alias("domain"), seeds.alias("seed_urls"),
        *[number(n).cast("long").alias(n) for n in INT_FIELDS], *[number(n).alias(n) for n in RATE_FIELDS],
    )


def has_thresholds() -> Column:
    return F.coalesce(*[F.col(t).cast("double") for t in THRESHOLDS]).isNotNull()
