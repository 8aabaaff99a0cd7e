"""Text expressions: trimming, sentences, snippets, tokens and stems."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import fixed_values as V
from quarrylight.session import bound_batches

# White space characters, beyond the plain blank of trim().
WHITE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_WS = r"(?U)\s+"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITE))


def collapse(c: Column) -> Column:
    """One blank between words, none at the ends."""
    return F.trim(F.regexp_replace(c, _WS, " "))


def non_blank(c: Column) -> Column:
    return F.when(c.rlike(r"(?U)\S"), c)


#: White space of ``_WS``; all but the last four characters at which Python splits.
_BLANKS, _NO_BLANKS = re.compile("[" + re.escape("".join(w for w in WHITE if not "\x1c" <= w <= "\x1f")) + "]+"), re.compile("[\x1c-\x1f]")
_LONG_TOKEN = re.compile("[a-z0-9]{3,}")
#: Queries that meet one copy of a text.
AT_A_TEXT = 128


def _collapsed(text: str) -> str:
    return _BLANKS.sub(" ", text).strip(" ") if _NO_BLANKS.search(text) else " ".join(text.split())


_PLAIN = bytes(b if chr(b) in " .0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" else 0x20 for b in range(256))
_FOLLOWING = bytes(range(0x80, 0xC0))


def _plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, plain): one pass over the bytes of each text; of a longer character only the first byte is kept, as its blank."""
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        rows = [t.as_py().translate(_PLAIN, _FOLLOWING) if t.is_valid else None for t in texts]
        yield pa.record_batch([batch.column("id"), pa.array(rows, pa.binary()).cast(pa.string())], names=["id", "plain"])


def plain_texts(texts: DataFrame) -> DataFrame:
    """(id, plain) of texts(id, text): a blank for every character but A-Z, a-z, digits, blanks and full stops."""
    bound_batches(texts.sparkSession)
    return texts.select("id", "text").mapInArrow(_plain, "id long, plain string")


def sanitize_short_text(c: Column, limit: int = V.SHORT_TEXT_LIMIT) -> Column:
    clean = collapse(c)
    return F.when(clean != "", F.rtrim(F.substring(clean, 1, limit)))


def enum_label(c: Column, table: Sequence[tuple[str, str]]) -> Column:
    """Label of the first table entry found in the text, else NULL."""
    low = F.lower(c)
    out = None
    for fragment, label in table:
        hit = F.contains(low, F.lit(fragment))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def days_from_text(c: Column) -> Column:
    """The first standalone one- or two-digit number, if it is 1..14."""
    n = F.regexp_extract(c, r"(?U)\b(\d{1,2})\b", 1).try_cast("int")
    return F.when(n.between(1, 14), n)


def clamp_unit(c: Column) -> Column:
    """Clamp a double to 0..1; NaN counts as missing."""
    return F.when(c.isNotNull() & ~F.isnan(c), F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))


def first_sentence(c: Column, limit: int = V.SENTENCE_LIMIT) -> Column:
    """Text up to the first full stop, question or exclamation mark that is
    followed by more text; reads no further than that."""
    cut = F.nullif(F.regexp_extract(c, r"(?sU)^\s*(.*?[.!?])\s+\S", 1), F.lit(""))
    sentence = F.coalesce(cut, F.nullif(strip(c), F.lit("")))
    return F.when(F.length(sentence) > limit, F.concat(rstrip(F.substring(sentence, 1, limit)), F.lit("..."))).otherwise(sentence)


def is_meta_text(c: Column) -> Column:
    return F.lower(F.substring(c, 1, V.META_SAMPLE)).rlike("|".join(V.META_TEXT_PHRASES))


def content_text(title: Column, summary: Column, body: Column) -> Column:
    empty = F.lit("")
    return F.concat_ws("\n", F.nullif(title, empty), F.nullif(summary, empty), F.nullif(body, empty))


def bounded(c: Column, limit: int) -> Column:
    """Cut long text at the last blank of the limit and mark the cut."""
    head = F.substring(c, 1, limit)
    at_word = F.regexp_extract(head, r"(?s)^(.*) ", 1)
    has_blank = F.contains(head, F.lit(" "))
    return F.when(F.length(c) <= limit, c).otherwise(
        F.concat(F.when(has_blank, at_word).otherwise(head), F.lit(" …"))
    )


def labelled_lines(fields: Sequence[tuple[str, Column]]) -> Column:
    """``name: value`` lines; NULL and empty values leave no line."""
    lines = [
        F.when(value.cast("string") != "", F.concat(F.lit(f"{name}: "), value.cast("string")))
        for name, value in fields
    ]
    return F.concat_ws("\n", *lines)


def program_text(c: dict[str, Column]) -> Column:
    return labelled_lines(
        [
            ("program", c["name"]),
            ("summary", c["summary"]),
            ("experience level", c["experience_level"]),
            ("days per week", c["days_per_week"]),
            ("specialization", c["specialization"]),
            ("progression", c["progression_type"]),
            ("split", c["split_type"]),
            ("coach", c["coach_name"]),
            ("source title", c["source_title"]),
            ("source url", c["canonical_url"]),
            ("source content", bounded(c["raw_text"], V.PROGRAM_TEXT_LIMIT)),
        ]
    )


def evidence_text(c: dict[str, Column]) -> Column:
    return labelled_lines(
        [
            ("source title", c["source_title"]),
            ("source type", c["source_type"]),
            ("author", c["author"]),
            ("source url", c["canonical_url"]),
            ("source content", bounded(c["raw_text"], V.EVIDENCE_TEXT_LIMIT)),
        ]
    )


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9]+)"), F.lit(1))


def stem(t: Column) -> Column:
    """Harman's three-rule S-stemmer for one lower-case token."""
    n = F.length(t)
    ies = t.endswith("ies") & ~t.endswith("eies") & ~t.endswith("aies")
    es = t.endswith("es") & ~t.endswith("aes") & ~t.endswith("ees") & ~t.endswith("oes")
    plural = t.endswith("s") & ~t.endswith("us") & ~t.endswith("ss")
    return (
        F.when(ies, F.concat(F.substr(t, F.lit(1), n - 3), F.lit("y")))
        .when(es | plural, F.substr(t, F.lit(1), n - 1))
        .otherwise(t)
    )


def is_stop_word(t: Column) -> Column:
    return t.isin(*V.STOP_WORDS)


def lexemes(c: Column) -> Column:
    """Distinct stems of the non-stop tokens of a query, in first-seen order."""
    kept = F.filter(tokens(c), lambda t: ~is_stop_word(t))
    return F.array_distinct(F.transform(kept, stem))


def with_snippet(
    df: DataFrame, text: str, query: str, name: str = "snippet", size: int = V.SNIPPET_CHARS, lead: int = V.SNIPPET_LEAD
) -> DataFrame:
    """Add a window of the text around its earliest query term, or its head.

    Built in steps so that the text is cleaned once per row, not once per term.
    """
    terms = F.filter(tokens(F.col(query)), lambda t: F.length(t) > 2)
    hits = F.filter(F.transform(terms, lambda t: F.position(t, F.col("_low"))), lambda i: i > 0)
    rows = df.withColumn("_flat", collapse(F.col(text))).withColumn("_low", F.lower("_flat"))
    rows = rows.withColumn("_first", F.array_min(hits))
    flat, first = F.col("_flat"), F.col("_first")
    start = F.greatest(F.lit(0), first - 1 - F.lit(lead))
    end = F.least(F.length(flat), start + F.lit(size))
    dots, none = F.lit("..."), F.lit("")
    around = F.concat(
        F.when(start > 0, dots).otherwise(none),
        F.trim(F.substr(flat, start + 1, end - start)),
        F.when(end < F.length(flat), dots).otherwise(none),
    )
    head = F.concat(F.substring(flat, 1, size), F.when(F.length(flat) > size, dots).otherwise(none))
    out = F.when(flat != "", F.when(first.isNull(), head).otherwise(around))
    return rows.withColumn(name, out).drop("_flat", "_low", "_first")


def _cut_out(flat: str, first: int | None, size: int, lead: int) -> str | None:
    """The window of ``with_snippet``, for the place of the earliest term or none."""
    if not flat:
        return None
    if first is None:
        return flat[:size] + ("..." if len(flat) > size else "")
    start = max(0, first - lead)
    end = min(len(flat), start + size)
    return ("..." if start > 0 else "") + flat[start:max(start, end)].strip(" ") + ("..." if end < len(flat) else "")


def _snippets(batches: Iterator[pa.RecordBatch], size: int, lead: int) -> Iterator[pa.RecordBatch]:
    """(id, query, snippet): each text is cleaned once for all queries that came with it, and a term is sought before the earliest one found."""
    for batch in batches:
        ids, queries, found = [], [], []
        for at, text, asked in zip(batch.column("id").to_pylist(), batch.column("text").cast(pa.binary()), batch.column("queries").to_pylist(), strict=True):
            ids += [at] * len(asked)
            queries += asked
            if not text.is_valid:
                found += [None] * len(asked)
                continue
            flat = _collapsed(text.as_py().decode(errors="replace"))
            low, missing = flat.lower(), set()
            for query in asked:
                first = None
                for term in dict.fromkeys(_LONG_TOKEN.findall((query or "").lower())):
                    if term in missing:
                        continue
                    place = low.find(term) if first is None else low.find(term, 0, first + len(term) - 1)
                    if place >= 0:
                        first = place
                    elif first is None:
                        missing.add(term)
                found.append(_cut_out(flat, first, size, lead))
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(queries, pa.string()), pa.array(found, pa.string())], names=["id", "query", "snippet"])


def snippets(asked: DataFrame, texts: DataFrame, size: int = V.SNIPPET_CHARS, lead: int = V.SNIPPET_LEAD) -> DataFrame:
    """(id, query, snippet) of asked(id, query): what ``with_snippet`` gives for the query and each text of texts(id, text).

    A text is read once for ``AT_A_TEXT`` of its queries or so, and not joined to each of them.
    """
    bound_batches(asked.sparkSession)
    pairs = asked.select("id", "query").where("id IS NOT NULL").distinct()
    per = pairs.groupBy("id").agg(F.ceil(F.count("*") / F.lit(AT_A_TEXT)).alias("slices"))
    lists = pairs.join(per, "id").groupBy("id", F.pmod(F.xxhash64("query"), F.col("slices")).alias("slice")).agg(
        # A list leaves out nulls, a list of records does not.
        F.transform(F.collect_list(F.struct("query")), lambda x: x["query"]).alias("queries")
    )
    rows = texts.select("id", "text").join(lists, "id").select(F.col("id").cast("long").alias("id"), "text", "queries")
    return rows.mapInArrow(partial(_snippets, size=size, lead=lead), "id long, query string, snippet string")
