"""Query expansion and intent inference as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylight.functions import fixed_values as V
from quarrylight.functions.text import strip, tokens


def normalized_query(query: Column) -> Column:
    return strip(F.replace(F.lower(query), F.lit("–"), F.lit("-")))


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def expanded_terms(query: Column) -> Column:
    """Phrase terms in table order, then the remaining tokens, without repeats."""
    norm = normalized_query(query)
    nothing = F.array().cast("array<string>")
    rest = norm
    from_phrases = []
    for phrase, terms in V.PHRASE_EXPANSIONS:
        found = F.contains(norm, F.lit(phrase))
        from_phrases.append(F.when(found, _strings(terms)).otherwise(nothing))
        # An empty search string leaves the text as it is.
        rest = F.replace(rest, F.when(found, phrase).otherwise(""), F.lit(" "))
    table = F.create_map(*[x for tok, terms in V.TOKEN_EXPANSIONS for x in (F.lit(tok), _strings(terms))])
    from_tokens = F.flatten(
        F.transform(tokens(rest), lambda t: F.coalesce(F.try_element_at(table, t), F.array(t)))
    )
    return F.array_distinct(F.concat(*from_phrases, from_tokens))


def intent_days(query: Column) -> Column:
    norm = normalized_query(query)
    digits = F.regexp_extract(norm, r"(?U)\b([2-6])\s*-?\s*days?\b", 1).try_cast("int")
    out = F.when(digits.isNotNull(), digits)
    for word, value in V.DAY_WORDS:
        out = out.when(norm.rlike(rf"(?U)\b{word}\s*-?\s*days?\b"), value)
    return out


def intent_experience(query: Column) -> Column:
    norm = normalized_query(query)
    return (
        F.when(norm.rlike("post novice|intermediate"), "intermediate")
        .when(norm.rlike("novice|beginner|first meet"), "beginner")
        .when(norm.rlike("advanced"), "advanced")
    )


def intent_split(query: Column) -> Column:
    norm = normalized_query(query)
    return F.when(norm.rlike("full body"), "full-body").when(norm.rlike("upper lower"), "upper-lower")
