"""Language identification by rank-order profiles of character n-grams.

A language's profile is the list of its ``PROFILE`` most frequent n-grams over
all its training texts; a document is compared by the out-of-place distance of
its own most frequent n-grams. An n-gram is up to three letters of a word,
lower-cased and with a blank before and after it. Equal counts are ordered by
the n-gram's code points, so a ranking never depends on the partitioning.
"""

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm import common
from quarrylight.llm.common import bounded_batches

PROFILE, LONGEST, MAX_LANGUAGES = 300, 3, 2000
#: Bytes of text whose n-grams are numbered together.
TEXT_SLICE = 1 << 20
UNKNOWN = "und"
BLANK = 32
#: Tasks pass their counts on when they hold so many n-grams.
HELD = 1_000_000
_BITS = 21
#: Cells of the direct numbering of a slice's n-grams; a slice with a larger alphabet is numbered by sorting.
_CELLS = 1 << 22


class Grams:
    """The n-grams of some texts: ``codes`` (sorted), and for each text the counts of these.

    A code has the code points side by side, 21 bits each, so codes sort as the n-grams do.
    """

    def __init__(self, texts: list[bytes | None]):
        lowered = [f" {x.decode('utf-8', 'replace').lower()} " if x else " " for x in texts]
        points = np.frombuffer("".join(lowered).encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        alphabet, letters = np.unique(points, return_inverse=True)
        spoken = np.array([chr(x).isalpha() for x in alphabet])
        alphabet = np.where(spoken, alphabet, BLANK)
        blank = ~spoken[letters]
        ends = np.cumsum(np.array([len(x) for x in lowered], np.int64))
        # Runs of blanks are one blank, but every text has its own at the start.
        kept = ~(blank & np.concatenate(([False], blank[:-1])))
        kept[ends[:-1]] = True
        self.bounds = np.concatenate(([0], np.cumsum(kept)[ends - 1])) if len(lowered) else np.zeros(1, np.int64)
        # Blanks are one letter of the alphabet from here on.
        distinct, same = np.unique(alphabet, return_inverse=True)
        a = same[letters[kept]]
        gap = distinct[a] == BLANK
        base = len(distinct) + 1
        b, c = np.append(a[1:], 0), np.append(a[2:], (0, 0))
        grams = [(a + 1) * base * base, ((a + 1) * base + b + 1) * base, ((a + 1) * base + b + 1) * base + c + 1]
        gap_b = np.append(gap[1:], True)
        valid = [~gap, ~(gap & gap_b), ~gap_b]
        valid[1][-1:], valid[2][-2:] = False, False
        if base**LONGEST <= _CELLS:
            seen = np.zeros(base**LONGEST, bool)
            for gram, good in zip(grams, valid, strict=True):
                seen[gram[good]] = True
            keys = np.flatnonzero(seen)
            number = np.cumsum(seen) - 1
            self.numbers = [number[gram] for gram in grams]
        else:
            keys = np.unique(np.concatenate([gram[good] for gram, good in zip(grams, valid, strict=True)]))
            self.numbers = [np.searchsorted(keys, gram) for gram in grams]
        self.valid = valid
        wide = np.concatenate(([0], distinct))
        self.codes = wide[keys // (base * base)] << 2 * _BITS | wide[keys // base % base] << _BITS | wide[keys % base]

    def counts(self, i: int) -> np.ndarray:
        low, high = self.bounds[i], self.bounds[i + 1]
        found = np.concatenate([n[low:high][v[low:high]] for n, v in zip(self.numbers, self.valid, strict=True)])
        return np.bincount(found, minlength=len(self.codes))


class Profiles:
    """The learned profiles, for judging."""

    def __init__(self, profiles: dict[str, list[int]]):
        self.languages = sorted(profiles)
        self.codes = [np.array(profiles[x], np.int64) for x in self.languages]
        self.orders = [np.argsort(x) for x in self.codes]

    def ranks(self, codes: np.ndarray) -> np.ndarray:
        """The rank of each code in each language; ``PROFILE`` where it is not in the profile."""
        out = np.full((len(codes), len(self.languages)), PROFILE, np.int16)
        for i, (own, order) in enumerate(zip(self.codes, self.orders, strict=True)):
            at = np.minimum(np.searchsorted(own, codes, sorter=order), len(own) - 1)
            hit = own[order[at]] == codes
            out[hit, i] = order[at[hit]]
        return out

    def judge(self, texts: list[bytes | None]) -> list[tuple[str, float]]:
        """(language, score) of each text: 1 is the profile itself, 0 has no n-gram of it."""
        grams = Grams(texts)
        ranks, found = self.ranks(grams.codes), []
        for i in range(len(texts)):
            counts = grams.counts(i)
            there = np.flatnonzero(counts)
            if not len(there) or not self.languages:
                found.append((UNKNOWN, 0.0))
                continue
            often = counts[there]
            if len(there) > PROFILE:
                there = there[often >= np.partition(often, -PROFILE)[-PROFILE]]
            # Numbers are in the order of the codes, so a stable sort settles equal counts.
            top = there[np.argsort(-counts[there], kind="stable")][:PROFILE]
            own = ranks[top].astype(np.int64)
            distances = np.where(own == PROFILE, PROFILE, np.abs(own - np.arange(len(top))[:, None])).sum(axis=0)
            best = int(distances.argmin())
            found.append((self.languages[best], 1.0 - float(distances[best]) / (PROFILE * len(top))))
        return found


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-gram counts per language of what a task reads."""
    sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def flushed() -> Iterator[pa.RecordBatch]:
        for language, (codes, counts) in sums.items():
            yield pa.record_batch([pa.array([language] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], names=["lang", "code", "n"])
        sums.clear()

    for batch in batches:
        for part in common.slices(batch, "text", TEXT_SLICE):
            languages = part.column("lang").to_pylist()
            grams = Grams(common.texts(part))
            new: dict[str, np.ndarray] = {}
            for i, language in enumerate(languages):
                counts = grams.counts(i)
                new[language] = new[language] + counts if language in new else counts
            for language, counts in new.items():
                there = np.flatnonzero(counts)
                codes, n = grams.codes[there], counts[there].astype(np.int64)
                if language in sums:
                    old = sums[language]
                    codes, at = np.unique(np.concatenate((old[0], codes)), return_inverse=True)
                    n = np.bincount(at, np.concatenate((old[1], n))).astype(np.int64)
                sums[language] = codes, n
            if sum(len(x[0]) for x in sums.values()) > HELD:
                yield from flushed()
    yield from flushed()


def fit_profiles(docs: DataFrame, *, text_column: str = "text", lang_column: str = "lang") -> dict[str, list[int]]:
    """language -> its most frequent n-gram codes, over all rows with a text and a language.

    The driver receives at most ``PROFILE`` numbers for each of at most
    ``MAX_LANGUAGES`` languages; more languages are an error.
    """
    bounded_batches(docs.sparkSession)
    counts = (
        docs.select(F.col(lang_column).cast("string").alias("lang"), common.text_column(text_column).alias("text"))
        .where("lang IS NOT NULL AND text IS NOT NULL")
        .mapInArrow(_counted, "lang string, code long, n long")
        .groupBy("lang", "code").agg(F.sum("n").alias("n"))
    )
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    rows = counts.withColumn("place", place).where(f"place <= {PROFILE}").limit(PROFILE * MAX_LANGUAGES + 1).collect()
    if len(rows) > PROFILE * MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    profiles: dict[str, list[int]] = {}
    for row in sorted(rows, key=lambda r: (r["lang"], r["place"])):
        profiles.setdefault(row["lang"], []).append(row["code"])
    return profiles


def language(text: Column, profiles: dict[str, list[int]]) -> Column:
    """A column struct(lang, score) for a column of texts.

    The language is a learned one, ``und`` with score 0 if the text is null or
    has no letters or nothing was learned. Equal distances go to the first
    language by name.
    """
    @F.arrow_udf("struct<lang: string, score: double>")
    def judged(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Profiles(profiles)
        for column in columns:
            batch = pa.record_batch([column], names=["text"])
            found = [x for part in common.slices(batch, "text", TEXT_SLICE) for x in known.judge(common.texts(part))]
            yield pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["lang", "score"])

    return judged.asNondeterministic()(text.cast("string"))


def identify(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", folds: int = 5) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row; the rows of fold 0 are not learned from.

    A row's fold is ``crc32`` of its id as text modulo ``folds``; a row without
    an id counts as held out. Repeated rows are each returned, other columns are ignored.
    """
    held_out = F.coalesce(common.fold(id_column, folds) == 0, F.lit(True))
    profiles = fit_profiles(docs.where(~held_out), text_column=text_column, lang_column=lang_column)
    judged = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), held_out.alias("held_out"), language(F.col(text_column), profiles).alias("found")
    )
    return judged.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))
