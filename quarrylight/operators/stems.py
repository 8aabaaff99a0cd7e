"""Suffix stripping (Porter 1980) as one job over the vocabulary.

The rules are tables; each step takes the longest suffix that fits and applies
its rule if what is left satisfies the condition. They are written out as SQL
expressions over distinct tokens, and stems are joined back by token, so no
text and no posting is stemmed by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import fixed_values as V

_VOWEL, _SHORT_END = "[aeiouy]", "[^aeiouy][aeiouy][^aeiouywxY]$"
_DOUBLE_END = "(" + "|".join(2 * c for c in "bcdfghjklmnpqrstvwxz") + ")$"


class Dialect:
    """What the two engines spell differently."""

    def __init__(self, measure: str, matches: str, replace_all: str):
        self._measure, self._matches, self._replace_all = measure, matches, replace_all

    def measure(self, word: str) -> str:
        """How many runs of vowels are followed by consonants."""
        return self._measure.format(word=word, pattern=f"{_VOWEL}+[^aeiouy]+")

    def matches(self, word: str, pattern: str) -> str:
        return self._matches.format(word=word, pattern=pattern)

    def marked(self, word: str) -> str:
        """A y that is a consonant, at the start or after a vowel, becomes Y."""
        return f"replace({self._replace_all.format(word=word, pattern='(^|[aeiou])y')}, 'yy', 'yY')"


SPARK = Dialect("size(regexp_extract_all({word}, '({pattern})', 1))", "{word} RLIKE '{pattern}'", "regexp_replace({word}, '{pattern}', '$1Y')")
DUCKDB = Dialect("len(regexp_extract_all({word}, '{pattern}'))", "regexp_matches({word}, '{pattern}')", "regexp_replace({word}, '{pattern}', '\\1Y', 'g')")


def steps(d: Dialect) -> list[str]:
    """The steps as expressions of ``w``, each the next one's ``w``."""

    def cut(n: int) -> str:
        return f"substr(w, 1, length(w) - {n})" if n else "w"

    def rules(table, condition) -> str:
        """The longest suffix decides; its rule applies where ``condition`` of what is left holds."""
        cases = []
        for suffix, new in sorted(table, key=lambda r: -len(r[0])):
            left = cut(len(suffix))
            cases.append(f"WHEN w LIKE '%{suffix}' THEN CASE WHEN {condition(left, suffix)} THEN {left} || '{new}' ELSE w END")
        return f"CASE {' '.join(cases)} ELSE w END"

    def above(n: int):
        return lambda left, _: f"{d.measure(left)} > {n}"

    def last_step(left: str, suffix: str) -> str:
        return f"{d.measure(left)} > 1" + (f" AND {d.matches(left, '[st]$')}" if suffix == "ion" else "")

    past = " ".join(
        f"WHEN w LIKE '%{s}' THEN CASE WHEN {d.matches(cut(len(s)), _VOWEL)} THEN {cut(len(s))} || '+' ELSE w END" for s in ("ing", "ed")
    )
    # '+' marks what lost ed or ing, for the repair after it.
    repaired = (
        f"CASE WHEN w NOT LIKE '%+' THEN w WHEN w LIKE '%at+' OR w LIKE '%bl+' OR w LIKE '%iz+' THEN {cut(1)} || 'e' "
        f"WHEN {d.matches(cut(1), _DOUBLE_END)} AND NOT {d.matches(cut(1), '[lsz]$')} THEN {cut(2)} "
        f"WHEN {d.measure(cut(1))} = 1 AND {d.matches(cut(1), _SHORT_END)} THEN {cut(1)} || 'e' ELSE {cut(1)} END"
    )
    final = (
        f"CASE WHEN w LIKE '%e' AND ({d.measure(cut(1))} > 1 OR ({d.measure(cut(1))} = 1 AND NOT {d.matches(cut(1), _SHORT_END)})) THEN {cut(1)} ELSE w END"
    )
    return [
        d.marked("w"),
        rules(V.STEM_PLURALS, lambda left, _: "true"),
        f"CASE WHEN w LIKE '%eed' THEN CASE WHEN {d.measure(cut(3))} > 0 THEN {cut(1)} ELSE w END {past} ELSE w END",
        repaired,
        f"CASE WHEN (w LIKE '%y' OR w LIKE '%Y') AND {d.matches(cut(1), _VOWEL)} THEN {cut(1)} || 'i' ELSE w END",
        rules(V.STEM_DOUBLE_SUFFIXES, above(0)),
        rules(V.STEM_SUFFIXES, above(0)),
        rules([(s, "") for s in V.STEM_ENDINGS], last_step),
        final,
        f"CASE WHEN w LIKE '%ll' AND {d.measure(cut(1))} > 1 THEN {cut(1)} ELSE w END",
        "lower(w)",
    ]


def stems(tokens: DataFrame) -> DataFrame:
    """``tokens`` (token, ...) with ``stem``; tokens of one or two letters stay as they are. One row a token is meant to come."""
    rows = tokens.withColumn("w", F.col("token"))
    for step in steps(SPARK):
        rows = rows.withColumn("w", F.expr(step))
    return rows.withColumn("stem", F.when(F.length("token") <= 2, F.col("token")).otherwise(F.col("w"))).drop("w")


def stems_sql(source: str) -> str:
    """SQL that adds ``stem`` to the rows of ``source`` (token, ...)."""
    sql = f"SELECT *, token AS w FROM ({source})"
    for step in steps(DUCKDB):
        sql = f"SELECT * REPLACE ({step} AS w) FROM ({sql})"
    return f"SELECT * EXCLUDE (w), CASE WHEN length(token) <= 2 THEN token ELSE w END AS stem FROM ({sql})"
