"""Extraction payloads to clean documents, programs and claims.

All of it is one map over the payload table: programs and claims stay nested
in their document row, so nothing is shuffled until a child table is wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions import errors as ERR
from quarrylight.functions import fixed_values as V
from quarrylight.functions import payload as P
from quarrylight.functions import text as T
from quarrylight.functions import urls as U


def coerce(payloads: DataFrame) -> DataFrame:
    """Add ``own`` (payload as string), ``obj`` (payload object) and ``payload_type``."""
    raw = F.col("output")
    step = payloads.withColumn("own", P.own_text(raw))
    step = step.withColumn("obj", P.as_object(raw, F.col("own")))
    return step.withColumn("payload_type", P.payload_type(raw, F.col("own"), F.col("obj")))


def fields(coerced: DataFrame) -> DataFrame:
    """Add title, author, source_type, summary and raw_text."""
    obj = F.col("obj")
    fallback = F.when(F.col("payload_type") == "string", F.nullif(F.col("own"), F.lit("")))
    return coerced.select(
        "document_id", "source_id", "url", "obj", "payload_type",
        P.first_non_empty(obj, V.TITLE_KEYS).alias("title"),
        P.first_non_empty(obj, V.AUTHOR_KEYS).alias("author"),
        T.sanitize_short_text(P.first_non_empty(obj, V.SOURCE_TYPE_KEYS)).alias("source_type"),
        P.first_non_empty(obj, V.SUMMARY_KEYS).alias("summary"),
        F.coalesce(P.first_non_empty(obj, V.TEXT_KEYS), fallback).alias("raw_text"),
    )


def inferred_program(url: Column, title: Column, summary: Column, raw_text: Column) -> Column:
    """The program a program page is about, when none was extracted."""
    name = T.strip(title)
    row = F.struct(
        name.alias("name"), F.lit(None).cast("string").alias("coach_name"),
        T.days_from_text(raw_text).cast("bigint").alias("days_per_week"),
        T.enum_label(name, V.SPECIALIZATION).alias("specialization"),
        F.lit(None).cast("string").alias("experience_level"),
        F.lit(None).cast("string").alias("progression_type"),
        F.lit(None).cast("string").alias("split_type"),
        F.coalesce(F.nullif(T.strip(summary), F.lit("")), T.first_sentence(raw_text)).alias("summary"),
        F.lit(0.35).alias("confidence"),
    )
    return F.when(U.is_program_focused_url(url) & (name != ""), row)


def parse_confidence(c: dict[str, Column]) -> Column:
    size = F.coalesce(F.length(T.strip(c["raw_text"])), F.lit(0))
    zero = F.lit(0.0)
    score = (
        F.lit(0.2)
        + F.when(c["title"].isNotNull(), 0.15).otherwise(zero)
        + F.when(size >= 2000, 0.3).when(size >= 500, 0.2).when(size >= 120, 0.1).otherwise(zero)
        + F.when(c["summary"].isNotNull(), 0.05).otherwise(zero)
        + F.when(F.size(c["programs"]) > 0, 0.2).otherwise(zero)
        + F.when(F.size(c["claims"]) > 0, 0.05).otherwise(zero)
        - F.when(c["payload_type"] != "object", 0.25).otherwise(zero)
        - F.when(c["programs_inferred"], 0.1).otherwise(zero)
    )
    return F.round(T.clamp_unit(score), 6)


def validation_errors(c: dict[str, Column]) -> Column:
    text = F.coalesce(T.strip(c["raw_text"]), F.lit(""))
    poor = (F.length(text) < 80) | T.is_meta_text(text)
    checks = F.array(
        F.when(poor, F.lit("low_quality_output")),
        F.when(U.is_program_focused_url(c["url"]) & (F.size(c["programs"]) == 0), F.lit("no_programs_on_program_page")),
    )
    return F.when(c["payload_type"] != "object", F.array(F.lit("schema_invalid"))).otherwise(F.array_compact(checks))


def normalize(payloads: DataFrame) -> DataFrame:
    """One row per payload with nested ``programs`` and ``claims``, the parse
    confidence, warnings and validation errors. ``obj`` keeps the original."""
    base = fields(coerce(payloads))
    programs = F.array_compact(F.transform(P.items(F.col("obj"), "programs"), P.program))
    claims = F.array_compact(F.transform(P.items(F.col("obj"), "claims"), P.claim))
    rows = base.withColumn("found", programs).withColumn("claims", claims)
    guess = inferred_program(F.col("url"), F.col("title"), F.col("summary"), F.col("raw_text"))
    rows = rows.withColumn("guess", F.when(F.size("found") == 0, guess))
    rows = rows.withColumn("programs_inferred", F.col("guess").isNotNull())
    rows = rows.withColumn(
        "programs", F.when(F.col("programs_inferred"), F.array("guess")).otherwise(F.col("found"))
    )
    cols = {k: F.col(k) for k in rows.columns}
    warnings = F.array_compact(
        F.array(
            F.when(F.col("payload_type") != "object", F.lit("schema_invalid")),
            F.when(F.col("programs_inferred"), F.lit("programs_inferred")),
        )
    )
    return rows.select(
        "document_id", "source_id", "url", "obj", "payload_type", "title", "author", "source_type", "summary",
        "raw_text", "programs", "claims", "programs_inferred", parse_confidence(cols).alias("parse_confidence"),
        warnings.alias("warnings"), validation_errors(cols).alias("validation_errors"),
    )


def structured_output(normalized: DataFrame) -> DataFrame:
    """(document_id, structured): one JSON object with all keys of the payload, nested
    values as they were, and the canonical fields in place of keys of their name.

    A payload that is no object gives the canonical fields alone; unknown ones are null.
    """
    fields = {"title": "title", "author": "author", "source_type": "source_type", "summary": "summary", "main_text": "raw_text"}
    claims = F.transform("claims", lambda c: F.struct(
        c["raw_ref"].alias("program_id"), c["claim_type"].alias("claim_type"), c["raw_text"].alias("raw_text"),
        c["normalized_value"].alias("normalized_value"), c["confidence"].alias("confidence")))
    values = {k: F.col(v).cast("variant") for k, v in fields.items()}
    values |= {"programs": F.to_variant_object("programs"), "claims": F.to_variant_object(claims)}
    canonical = F.map_from_arrays(F.array(*[F.lit(k) for k in values]), F.array(*values.values()))
    own = F.map_filter(F.try_variant_get("obj", "$", "map<string,variant>"), lambda k, _: ~k.isin(*values))
    merged = F.coalesce(F.map_concat(own, canonical), canonical)
    return normalized.select("document_id", F.to_json(F.to_variant_object(merged)).alias("structured"))


def program_rows(normalized: DataFrame) -> DataFrame:
    return normalized.select(
        "document_id", "source_id", F.posexplode("programs").alias("pos", "p"), "programs_inferred"
    ).select("document_id", "source_id", F.col("pos").cast("long").alias("pos"), "p.*", "programs_inferred")


def claim_rows(normalized: DataFrame) -> DataFrame:
    return normalized.select("document_id", F.posexplode("claims").alias("pos", "p")).select(
        "document_id", F.col("pos").cast("long").alias("pos"), "p.*"
    )


def link_claims(claims: DataFrame, programs: DataFrame) -> DataFrame:
    """Resolve ``raw_ref`` of claims(id, document_id, raw_ref) to program ids.

    Numbers are 0-based positions, or 1-based when out of range; other text is
    a program name, where the last program of that name wins. The two lookups
    are equality joins; a document holds few programs.
    """
    w = Window.partitionBy("document_id").orderBy("id")
    placed = programs.select("document_id", F.col("id").alias("program_id"), "name", (F.row_number().over(w) - 1).alias("at"))
    sizes = placed.groupBy("document_id").agg(F.count("*").alias("n"))
    by_name = placed.withColumn("key", F.nullif(F.lower(T.strip("name")), F.lit(""))).where("key IS NOT NULL")
    by_name = by_name.groupBy("document_id", "key").agg(F.max_by("program_id", "at").alias("named_id"))
    by_place = placed.select("document_id", F.col("at").cast("long").alias("at"), F.col("program_id").alias("placed_id"))

    number = T.strip(F.col("raw_ref")).try_cast("bigint")
    rows = claims.join(sizes, "document_id", "left").withColumn("number", number)
    at = F.when(F.col("number").between(0, F.col("n") - 1), F.col("number")).when(
        (F.col("number") - 1).between(0, F.col("n") - 1), F.col("number") - 1
    )
    key = F.when(F.col("number").isNull(), F.lower(T.strip(F.col("raw_ref"))))
    rows = rows.withColumn("at", at).withColumn("key", key)
    rows = rows.join(by_place, ["document_id", "at"], "left").join(by_name, ["document_id", "key"], "left")
    return rows.withColumn("program_id", F.coalesce("placed_id", "named_id")).drop("n", "number", "at", "key", "placed_id", "named_id")


def diagnostics(normalized: DataFrame, programs: DataFrame) -> DataFrame:
    stored = programs.groupBy("document_id").agg(F.count("*").alias("programs_in_db"))
    return normalized.join(stored, "document_id", "left").select(
        "document_id", "source_id", "payload_type", "parse_confidence",
        F.coalesce(F.length(T.strip(F.col("raw_text"))), F.lit(0)).cast("long").alias("raw_text_length"),
        F.size("programs").cast("long").alias("programs_in_payload"),
        F.size("claims").cast("long").alias("claims_count"),
        F.coalesce("programs_in_db", F.lit(0)).alias("programs_in_db"),
        F.array_join("validation_errors", ",").alias("validation_errors"),
        F.array_join("warnings", ",").alias("warnings"),
    )


def resolve_attempts(attempts: DataFrame, max_retries: int = V.MAX_RETRIES) -> DataFrame:
    """Final state of each job from attempts(job_id, attempt, job_type, message, error_type, invalid).

    Attempt 0 may be followed by ``max_retries`` more; an attempt is repeated
    only after a retryable error or, in an ``extract`` job, an invalid result.
    Only these change the model after the first attempt; others have none.
    The state is decided by the earliest attempt that succeeds, fails for good
    or is the last allowed: one hash aggregate, no window.
    """
    allowed = attempts.where(F.col("attempt").between(0, max_retries))
    failed = F.col("message").isNotNull()
    retryable = F.col("error_type").isin(*V.RETRYABLE_ERROR_TYPES) | (F.col("invalid") & (F.col("job_type") == "extract"))
    ends = ~failed | ~F.coalesce(retryable, F.lit(False)) | (F.col("attempt") == max_retries)
    last = allowed.groupBy("job_id").agg(
        F.max("job_type").alias("job_type"),
        F.min(F.when(ends, F.struct("attempt", "message", "error_type"))).alias("last"),
        F.max(F.struct("attempt", "message", "error_type")).alias("open"),
    )
    attempt = F.coalesce(F.col("last.attempt"), F.col("open.attempt"))
    message = F.when(F.col("last").isNotNull(), F.col("last.message")).otherwise(F.col("open.message"))
    total = max_retries + 1
    status = (
        F.when(F.col("last").isNull(), "running").when(F.col("last.message").isNull(), "succeeded").otherwise("failed")
    )
    model = F.when(F.col("job_type") == "extract", model_for(attempt))
    named = F.coalesce(F.concat(F.lit(" (model="), model, F.lit(")")), F.lit(""))
    text = (
        F.when(status == "failed", F.format_string(f"%s failed after %d/{total} attempts: %s", "job_type", attempt + 1, message))
        .when(status == "running", F.format_string(
            f"%s attempt %d/{total} failed%s: %s; retrying", "job_type", attempt + 1, named, message))
    )
    retries = F.when(status == "running", attempt + 1).otherwise(attempt)
    code = F.when(status == "failed", ERR.error_code(message, F.coalesce("last.error_type", "open.error_type")))
    return last.select(
        "job_id", status.alias("status"), retries.cast("long").alias("retry_count"), model.alias("model"),
        text.alias("error_message"), code.alias("error_code"),
    )


def model_for(attempt: Column, primary: str = "primary", fallback: str = "fallback") -> Column:
    return F.when(attempt == 0, primary).otherwise(fallback)


def raw_html(normalized: DataFrame) -> DataFrame:
    """(document_id, html): the extracted page, or its text in a bare page."""
    body = F.coalesce("raw_text", F.lit(""))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        body = F.replace(body, F.lit(char), F.lit(entity))
    page = F.concat(F.lit("<html><body><pre>"), body, F.lit("</pre></body></html>"))
    return normalized.select("document_id", "source_id", F.coalesce(P.first_non_empty(F.col("obj"), V.HTML_KEYS), page).alias("html"))
