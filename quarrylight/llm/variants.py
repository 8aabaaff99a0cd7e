"""Spelling variants by generation over a reduced alphabet.

Letters are hashed to a few symbols. Words one edit apart have reduced forms
that are equal or one edit apart, so the full one-edit neighbourhood of a
reduced word, made over the few symbols, holds the reduced forms of all its
near words. Neighbourhoods are made once for each distinct reduced word, as
64-bit codes, and joined with the codes of the reduced vocabulary; a match is
asked for from the side of the smaller code only. The words behind two matched
reduced words are joined and verified letter by letter inside the join.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm import common
from quarrylight.llm.common import Scratch

#: Symbols of the reduced alphabet. More symbols make more neighbours and fewer words behind each.
SYMBOLS = 6
#: Of the crc32 of ``<doc_id>:<run>``, what divides it marks a run that loses a letter.
DAMAGE = 97
#: Distinct words that a task counts before it passes its counts on.
COUNTED = 400_000
#: Neighbour codes made at once.
MADE = 2_000_000
#: Base of the polynomial code of a reduced word, and its inverse modulo 2^64.
BASE = int(common.MIX_A)
INVERSE = pow(BASE, -1, 1 << 64)


def _counted(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(word, n) over the runs of letters of at least ``least`` code points. In Latin-1 a byte is a code point."""
    runs, counts = re.compile(rb"[a-z\xc0-\xff]{%d,}" % least), {}

    def taken() -> pa.RecordBatch:
        out = pa.record_batch([pa.array([w.decode("latin-1") for w in counts], pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
        counts.clear()
        return out

    for batch in batches:
        for part in common.slices(batch, "text"):
            for name, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
                own: dict[bytes, int] = {}
                # What lies outside Latin-1 becomes "?", which ends a run as it did before.
                for run in runs.findall((text or "").encode("latin-1", "replace").lower()):
                    own[run] = own.get(run, 0) + 1
                start = zlib.crc32(f"{name or ''}:".encode())
                for run, n in own.items():
                    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
                    if h % DAMAGE == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < least:
                            continue
                    counts[run] = counts.get(run, 0) + n
                if len(counts) > COUNTED:
                    yield taken()
    if counts:
        yield taken()


def vocabulary(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", least_letters: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n): the damaged, lower-cased runs of letters of all texts. Null ids count as empty, null texts have no runs."""
    source = docs.select(F.col(id_column).cast("string").alias("id"), common.text_column(text_column).alias("text"))
    found = source.mapInArrow(partial(_counted, least=least_letters), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def symbol_of(code_point: int, symbols: int) -> int:
    return (code_point * 0x9E3779B1 & 0xFFFFFFFF) * symbols >> 32


def neighbour_codes(reduced: np.ndarray, symbols: int) -> np.ndarray:
    """A row for each word of one length (rows of symbols from 1): its own code, then those of its one-edit neighbourhood.

    Neighbours that coincide are in a row more than once.
    """
    n, length = reduced.shape
    with np.errstate(over="ignore"):
        power = np.ones(length + 1, np.uint64)
        power[1:] = np.cumprod(np.full(length, BASE, np.uint64))
        terms = reduced.astype(np.uint64) * power[:length]
        before = np.zeros((n, length + 1), np.uint64)
        before[:, 1:] = np.cumsum(terms, axis=1, dtype=np.uint64)
        own = before[:, -1:]
        after = own - before
        letters = np.arange(1, symbols + 1, dtype=np.uint64)
        deleted = before[:, :-1] + after[:, 1:] * np.uint64(INVERSE)
        replaced = own[:, :, None] + (letters - reduced.astype(np.uint64)[:, :, None]) * power[:length, None]
        inserted = (before + after * np.uint64(BASE))[:, :, None] + letters * power[:, None]
    codes = np.concatenate([own, deleted, replaced.reshape(n, -1), inserted.reshape(n, -1)], axis=1)
    return common.mixed(codes)


def _neighbourhoods(batches: Iterator[pa.RecordBatch], symbols: int) -> Iterator[pa.RecordBatch]:
    """(key, reduced, home): the code of each reduced word (home), and those of its neighbours with a greater code."""
    for batch in batches:
        words = np.array(batch.column("reduced").to_pylist(), object)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for length in np.unique(lengths):
            chosen = np.nonzero(lengths == length)[0]
            step = max(1, MADE // int((2 * symbols + 1) * (length + 1)))
            for at in range(0, len(chosen), step):
                rows = chosen[at : at + step]
                letters = np.frombuffer("".join(words[rows]).encode("ascii"), np.uint8).reshape(len(rows), length) - 96
                codes = neighbour_codes(letters, symbols)
                own, codes = codes[:, :1], np.sort(codes[:, 1:], axis=1)
                asked = codes > own
                asked[:, 1:] &= codes[:, 1:] != codes[:, :-1]
                row, _ = np.nonzero(asked)
                keys = np.concatenate([own[:, 0], codes[asked]]).view(np.int64)
                home = np.zeros(len(keys), bool)
                home[: len(rows)] = True
                yield pa.record_batch(
                    [pa.array(keys), pa.array(words[np.concatenate([rows, rows[row]])], pa.string()), pa.array(home)], names=["key", "reduced", "home"]
                )


def near_words(words: DataFrame, scratch: Scratch, symbols: int = SYMBOLS) -> DataFrame:
    """(u, n_u, v, n_v): every unordered pair of the distinct ``words`` (word, n) that are exactly one edit apart, once."""
    letters = [*range(0x61, 0x7B), *range(0xC0, 0x100)]
    reduce = F.translate("word", "".join(map(chr, letters)), "".join(chr(97 + symbol_of(c, symbols)) for c in letters))
    named = scratch.save(words.select("word", "n", reduce.alias("reduced")), "reduced")
    made = scratch.save(
        named.select("reduced").distinct().mapInArrow(partial(_neighbourhoods, symbols=symbols), "key long, reduced string, home boolean"),
        "neighbourhoods", compression="zstd",
    )
    homes = made.where("home").select("key", F.col("reduced").alias("other"))
    matched = scratch.save(made.where("NOT home").join(homes, "key").select("reduced", "other"), "matched")
    scratch.drop("neighbourhoods")
    # Equal reduced words pair their own words once, in the order of the words.
    both = matched.union(named.groupBy("reduced").agg(F.count("*").alias("n")).where("n > 1").select("reduced", F.col("reduced").alias("other")))
    left = both.join(named.select("reduced", F.col("word").alias("u"), F.col("n").alias("n_u")), "reduced")
    right = named.select(F.col("reduced").alias("met"), F.col("word").alias("v"), F.col("n").alias("n_v"))
    one_edit = F.levenshtein("u", "v", 1) == 1
    return left.join(right, (F.col("other") == F.col("met")) & ((F.col("reduced") != F.col("other")) | (F.col("u") < F.col("v"))) & one_edit).select("u", "n_u", "v", "n_v")


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) for each row of ``forms`` (word, form): the last word that forms lead to. Paths are doubled in each round.

    Forms must not lead in a circle.
    """
    state = scratch.save(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots-0")
    step = 0
    while True:
        step += 1
        ahead = state.select(F.col("word").alias("at"), F.col("root").alias("next"))
        further = state.join(ahead, state.root == ahead["at"], "left")
        state = scratch.save(further.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"roots-{step}")
        if state.where("moved").isEmpty():
            return state.select("word", "root")
        scratch.drop(f"roots-{step - 1}")


def group_variants(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", least_letters: int = 5, least_count: int = 3, least_ratio: int = 2,
    symbols: int = SYMBOLS, scratch: Scratch | None = None,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of the vocabulary of ``docs``.

    Two words are near if one inserted, deleted or replaced code point makes one
    the other. ``form`` is the most frequent near word (of equal ones the first in
    code-point order) if it occurs at least ``least_ratio`` times as often, else
    null; ``root`` follows forms to the end. ``least_ratio`` must be above 1, so
    that forms do not lead in a circle. An empty table, null texts and texts
    without long runs give no words. Rows that repeat an id all count. Other
    columns are ignored.
    """
    if least_ratio <= 1:
        raise ValueError("least_ratio must be above 1")
    scratch = scratch or Scratch(docs.sparkSession, "variants")
    words = scratch.save(vocabulary(docs, id_column=id_column, text_column=text_column, least_letters=least_letters, least_count=least_count), "words")
    pairs = scratch.save(near_words(words, scratch, symbols), "pairs")
    sides = pairs.select(F.col("u").alias("word"), F.col("v").alias("near"), F.col("n_v").alias("n_near")).union(pairs.select("v", "u", "n_u"))
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_near")).alias("less"), "near")).alias("best"))
    form_n = -F.col("best.less")
    chosen = words.join(best, "word", "left").withColumn("good", F.coalesce(form_n >= least_ratio * F.col("n"), F.lit(False)))
    judged = scratch.save(
        chosen.select(
            "word", F.when(F.col("good"), F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(F.col("good"), form_n).alias("form_n"),
        ),
        "judged",
    )
    led = roots(judged, scratch)
    scratch.drop("reduced", "matched", "pairs", "words")
    return judged.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
