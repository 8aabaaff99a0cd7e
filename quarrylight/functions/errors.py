"""Crawl error classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylight.functions import fixed_values as V


def error_code(message: Column, error_type: Column) -> Column:
    """Code of the first rule whose fragment occurs in the message."""
    low = F.coalesce(F.lower(message), F.lit(""))
    kind = F.coalesce(error_type, F.lit(""))
    out = None
    for code, fragments in V.ERROR_RULES:
        hit = F.lit(False)
        for fragment in fragments:
            hit = hit | F.contains(low, F.lit(fragment))
        if code == "timeout":
            hit = hit | kind.isin(*V.TIMEOUT_ERROR_TYPES)
        out = F.when(hit, code) if out is None else out.when(hit, code)
    return out.when(kind.isin(*V.RETRYABLE_ERROR_TYPES), "retryable_browser_use").otherwise("terminal_error")


def error_kind(code: Column) -> Column:
    return (
        F.when(code.isNull() | (code == ""), F.lit(None).cast("string"))
        .when(code.startswith("blocked_"), "blocked")
        .when(code.isin(*V.RETRYABLE_CODES), "retryable")
        .otherwise("terminal")
    )
