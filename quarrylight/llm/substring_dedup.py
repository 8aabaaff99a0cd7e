"""Repeated word windows, by sorted window codes.

Every word position starts a suffix. Suffixes that share a window's length of
words would share a node of that depth in a suffix tree; as no other node
matters here, no tree is made. A suffix is cut off at a window's length and
spelled in four codes of a quarter window each. Suffixes are dealt out by the
first two codes and sorted by all four, then place: a suffix with the codes of
the one before repeats an earlier window. The pass holds no more than the last
suffix, whatever the size of a group.

Not every suffix is dealt out. Each window has an anchor, its lowest-coded run
of ``ANCHOR_WORDS`` words; equal windows have equal anchors. Only windows whose
anchor occurs twice can repeat, and anchors are a seventh of all positions.
What repeats within the rows that a task takes up at once is settled there, so
a passage in a third of all documents sends one row for each such slice.
Documents with equal texts are one document here: every window of the later
ones starts earlier in the first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm import common
from quarrylight.llm.common import Scratch, WordCodes, sequence_codes

WINDOW, ANCHOR_WORDS, QUARTERS = 20, 8, 4


def anchors_of(codes: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """For each window of the word codes the place of its anchor: the leftmost lowest run of ``anchor`` words."""
    runs = sequence_codes(codes, anchor, odd=3)
    width = window - anchor + 1
    n = len(codes) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, place = runs[:n].copy(), np.zeros(n, np.int64)
    for i in range(1, width):
        lower = runs[i : i + n] < best
        best[lower], place[lower] = runs[i : i + n][lower], i
    return np.arange(n) + place


def suffix_codes(codes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The first two and the last two quarters of the cut-off suffix at each window start, each a 64-bit code."""
    edges = [window * i // QUARTERS for i in range(QUARTERS + 1)]
    n = len(codes) - window + 1
    parts = []
    for i, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
        parts.append(sequence_codes(codes, high - low, odd=11 + i)[low : low + n] >> np.uint64(32))
    return parts[0] << np.uint64(32) | parts[1], parts[2] << np.uint64(32) | parts[3]


def _runs(rows: np.ndarray, parts: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, part, first, last) of each run of consecutive starts in one row."""
    breaks = np.flatnonzero((rows[1:] != rows[:-1]) | (parts[1:] != parts[:-1]) | (starts[1:] != starts[:-1] + 1))
    low, high = np.concatenate(([0], breaks + 1)), np.concatenate((breaks, [len(rows) - 1]))
    return rows[low], parts[low], starts[low], starts[high]


def _later(*keys: np.ndarray) -> np.ndarray:
    """Which places repeat the keys of an earlier place."""
    later = np.zeros(len(keys[0]), bool)
    order = np.lexsort(keys)  # stable: equal keys stay in their order
    same = np.ones(max(len(order) - 1, 0), bool)
    for key in keys:
        ordered = key[order]
        same &= ordered[1:] == ordered[:-1]
    later[order[1:][same]] = True
    return later


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _anchored(batches: Iterator[pa.RecordBatch], window: int, anchor: int) -> Iterator[pa.RecordBatch]:
    """(key, id, part, place, sure): the anchors of every document; ``sure`` ones were seen to repeat in this slice."""
    known = WordCodes()
    for batch in batches:
        for part in common.slices(batch, "text"):
            keys, ids, parts, places = [], [], [], []
            for row, own, text in zip(part.column("id").to_pylist(), part.column("part").to_pylist(), common.texts(part), strict=True):
                codes = known.of(common.words(text))
                found = np.unique(anchors_of(codes, window, anchor))
                keys.append(sequence_codes(codes, anchor, odd=3)[found])
                ids.append(np.full(len(found), row, np.int64))
                parts.append(np.full(len(found), own, np.int64))
                places.append(found)
            if not keys:
                continue
            key, row, own, place = (np.concatenate(x) for x in (keys, ids, parts, places))
            # One row of equal anchors stays for the other slices to meet; the rest is dealt out evenly.
            alone = _later(key)
            sure = np.isin(key, key[alone])
            key = np.where(alone, common.mixed(row.view(np.uint64) + place.view(np.uint64)), key)
            yield pa.record_batch([_signed(key), pa.array(row), pa.array(own), pa.array(place.astype(np.int32)), pa.array(sure), pa.array(alone)], names=["key", "id", "part", "place", "sure", "alone"])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, part, place) of the anchors that occur twice; rows come sorted by key."""
    last: tuple | None = None  # (key, id, part, place, given out, of another slice's group)
    for batch in batches:
        key, row, own, place = (batch.column(c).to_numpy() for c in ("key", "id", "part", "place"))
        sure, alone = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("sure", "alone"))
        if not len(key):
            continue
        same = np.zeros(len(key) + 1, bool)
        same[1:-1] = (key[1:] == key[:-1]) & ~alone[1:] & ~alone[:-1]
        if last is not None:
            same[0] = last[0] == key[0] and not alone[0] and not last[5]
        out = sure | same[:-1] | same[1:]
        ids, parts, places = row[out], own[out], place[out]
        if last is not None and same[0] and not last[4]:
            ids, parts, places = np.append(ids, last[1]), np.append(parts, last[2]), np.append(places, last[3]).astype(np.int32)
        last = key[-1], row[-1], own[-1], place[-1], out[-1], alone[-1]
        yield pa.record_batch([pa.array(ids), pa.array(parts), pa.array(places)], names=["id", "part", "place"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for the shuffle."""
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        bodies = pa.array([press.compress(x or b"") for x in common.texts(batch)], pa.binary())
        yield pa.record_batch([batch.column("id"), batch.column("part"), bodies], names=["id", "part", "body"])


def _suffixes(batches: Iterator[pa.RecordBatch], window: int, anchor: int) -> Iterator[pa.RecordBatch]:
    """(head, tail, id, part, first, last): leaves of the trees (``last`` is null), and the windows seen to repeat in this slice (runs)."""
    known, unpress = WordCodes(), zstandard.ZstdDecompressor()
    for batch in (x for whole in batches for x in common.slices(whole, "body", 1 << 20)):
        heads, tails, ids, parts, starts = [], [], [], [], []
        rows = sorted(zip(*(batch.column(c).to_pylist() for c in ("id", "part", "body", "places")), strict=True), key=lambda x: x[:2])
        for row, own, body, places in rows:
            codes = known.of(common.words(unpress.decompress(body)))
            marked = np.zeros(len(codes) + 1, bool)
            marked[np.array(places, np.int64)] = True
            start = np.flatnonzero(marked[anchors_of(codes, window, anchor)])
            head, tail = suffix_codes(codes, window)
            heads.append(head[start])
            tails.append(tail[start])
            ids.append(np.full(len(start), row, np.int64))
            parts.append(np.full(len(start), own, np.int64))
            starts.append(start)
        if not heads:
            continue
        head, tail, row, own, start = (np.concatenate(x) for x in (heads, tails, ids, parts, starts))
        later = _later(tail, head)
        leaf = ~later
        out = [head[leaf].view(np.int64)], [tail[leaf].view(np.int64)], [row[leaf]], [own[leaf]], [start[leaf]], [np.full(leaf.sum(), -1, np.int64)]
        if later.any():
            of, of_part, low, high = _runs(row[later], own[later], start[later])
            spread = common.mixed(common.mixed(of.view(np.uint64)) + low.view(np.uint64)).view(np.int64)
            for column, value in zip(out, (spread, np.zeros(len(low), np.int64), of, of_part, low, high), strict=True):
                column.append(value)
        yield pa.record_batch([pa.array(np.concatenate(x)) for x in out], names=["head", "tail", "id", "part", "first", "last"])


def _deep_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, part, first, last): all leaves but the first below each node of full depth; leaves come sorted by suffix, then place."""
    last = None
    for batch in batches:
        head, tail, row, own, first, end = (batch.column(c).to_numpy() for c in ("head", "tail", "id", "part", "first", "last"))
        if not len(head):
            continue
        leaf = end < 0
        deep = np.zeros(len(head), bool)
        deep[1:] = (head[1:] == head[:-1]) & (tail[1:] == tail[:-1]) & leaf[1:] & leaf[:-1]
        deep[0] = last is not None and last == (head[0], tail[0]) and leaf[0]
        last = (head[-1], tail[-1]) if leaf[-1] else None
        out = deep | ~leaf
        yield pa.record_batch([pa.array(row[out]), pa.array(own[out]), pa.array(first[out]), pa.array(np.where(leaf, first, end)[out])], names=["id", "part", "first", "last"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, part, n_words, kept_sha256, text_key) of the whole text."""
    for batch in batches:
        found = [(x or b"", common.words(x)) for x in common.texts(batch)]
        yield pa.record_batch(
            [
                batch.column("id"), batch.column("part"), pa.array([len(w) for _, w in found], pa.int64()),
                pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for _, w in found]), pa.array([hashlib.blake2b(b" ".join(w), digest_size=16).digest() for _, w in found], pa.binary()),
            ],
            names=["id", "part", "n_words", "kept_sha256", "text_key"],
        )


def kept_words(text: bytes, runs: list[tuple[int, int]], window: int) -> tuple[list[bytes], int]:
    """(the words that no run of windows covers, how many words there were)."""
    found = common.words(text)
    change = np.zeros(len(found) + 1, np.int64)
    for first, last in runs:
        change[first] += 1
        change[last + window] -= 1
    kept = np.cumsum(change[:-1]) == 0
    return [w for w, k in zip(found, kept, strict=True) if k], len(found)


def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    unpress = zstandard.ZstdDecompressor()
    for batch in batches:
        out = []
        for row, own, body, runs in zip(*(batch.column(c).to_pylist() for c in ("id", "part", "body", "runs")), strict=True):
            kept, n = kept_words(unpress.decompress(body), [(x["first"], x["last"]) for x in runs], window)
            joined = b" ".join(kept)
            out.append((row, own, n, n - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode("utf-8", "replace")))
        columns = list(zip(*out, strict=True)) or [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.record_batch(
            [pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)], names=["id", "part", "n_words", "n_removed", "kept_sha256", "kept_text"]
        )


class Repeats:
    """What ``find_repeats`` found: ``cut`` (id, part, n_words, n_removed, kept_sha256, kept_text) of the documents that lose
    words, and ``whole`` (id, part, n_words, kept_sha256, first) of all, ``first`` being the first (id, part) with the same words."""

    def __init__(self, cut: DataFrame, whole: DataFrame):
        self.cut, self.whole = cut, whole


def find_repeats(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, anchor: int = ANCHOR_WORDS, scratch: Scratch | None = None) -> Repeats:
    """Every window of ``window`` words that also starts earlier: smaller id, or same document, earlier start.

    Rows without an id are left out. A document is an id with a text: equal rows
    are one, and an id that comes with several texts is as many documents, in
    the order of ``part``, the hash of the text.
    """
    scratch = scratch or Scratch(docs.sparkSession, "substring-dedup")
    source = _named(docs, id_column, text_column).where("id IS NOT NULL")
    shape = {"window": window, "anchor": anchor}

    bare = scratch.save(source.mapInArrow(_whole, WHOLE), "whole")
    firsts = bare.groupBy("text_key").agg(F.min(F.struct("id", "part")).alias("first"))
    whole = scratch.save(bare.join(firsts, "text_key").select("id", "part", "n_words", "kept_sha256", "first"), "first")
    scratch.drop("whole")

    anchors = source.mapInArrow(partial(_anchored, **shape), "key long, id long, part long, place int, sure boolean, alone boolean")
    repeated = scratch.save(
        anchors.repartition(F.col("key")).sortWithinPartitions("key", "alone").mapInArrow(_repeated, "id long, part long, place int"), "anchors"
    )
    places = repeated.groupBy("id", "part").agg(F.collect_set("place").alias("places"))
    wanted = places.join(whole.where(_is_first()).select("id", "part").distinct(), ["id", "part"])
    packed = source.mapInArrow(_packed, "id long, part long, body binary")
    suspects = scratch.save(packed.join(wanted, ["id", "part"]).dropDuplicates(["id", "part"]), "suspects")

    leaves = suspects.mapInArrow(partial(_suffixes, **shape), "head long, tail long, id long, part long, first long, last long")
    repeats = scratch.save(
        leaves.repartition(F.col("head")).sortWithinPartitions("head", "tail", "id", "part", "first").mapInArrow(_deep_nodes, "id long, part long, first long, last long"),
        "repeats",
    )
    runs = repeats.groupBy("id", "part").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    cut = scratch.save(
        suspects.select("id", "part", "body").join(runs, ["id", "part"])
        .mapInArrow(partial(_cut, window=window), "id long, part long, n_words long, n_removed long, kept_sha256 string, kept_text string"),
        "cut",
    )
    scratch.drop("anchors", "suspects", "repeats")
    return Repeats(cut, whole)


WHOLE = "id long, part long, n_words long, kept_sha256 string, text_key binary"


def _named(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, text, part)"""
    text = common.text_column(text_column)
    return docs.select(F.col(id_column).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("part"))


def _is_first() -> Column:
    return (F.col("id") == F.col("first.id")) & (F.col("part") == F.col("first.part"))


def _decided(found: Repeats, window: int) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) for each row with an id; a later document with the same words loses all of them."""
    empty = hashlib.sha256(b"").hexdigest()
    copy = ~_is_first() & (F.col("n_words") >= window)
    cut = found.cut.select("id", "part", F.col("n_removed").alias("cut_words"), F.col("kept_sha256").alias("cut_sha256"))
    return found.whole.join(cut, ["id", "part"], "left").select(
        "id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("cut_words", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, F.lit(empty)).otherwise(F.coalesce("cut_sha256", "kept_sha256")).alias("kept_sha256"),
    )


def judge_repeats(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, anchor: int = ANCHOR_WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row: what ``remove_repeats`` does to it.

    A word is removed if a window of ``window`` words covers it whose words
    also start earlier: in a document of smaller id, or earlier in the same
    one. Windows are judged on the input. A null text has no words. Equal rows
    are one document and each returned; rows that repeat an id with other texts
    are documents of their own, in the order of the texts' hashes. Nothing is
    removed from a row without an id. Other columns are ignored.
    """
    found = find_repeats(docs, id_column=id_column, text_column=text_column, window=window, anchor=anchor)
    rest = _named(docs, id_column, text_column).where("id IS NULL").mapInArrow(_whole, WHOLE)
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    return (
        _decided(found, window).withColumnRenamed("id", "doc_id").select(columns)
        .union(rest.select(F.col("id").alias("doc_id"), "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256"))
    )


def remove_repeats(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, anchor: int = ANCHOR_WORDS) -> DataFrame:
    """All rows and columns of ``docs``; a text that lost words holds the kept ones, joined by one space.

    Texts that lose nothing stay as they are. See ``judge_repeats``.
    """
    found = find_repeats(docs, id_column=id_column, text_column=text_column, window=window, anchor=anchor)
    copies = found.whole.where(~_is_first() & (F.col("n_words") >= window)).select("id", "part", F.lit("").alias("kept_text"))
    changed = found.cut.select("id", "part", "kept_text").union(copies).groupBy("id", "part").agg(F.min("kept_text").alias("kept_text"))
    # One struct beside the rows, so no column name can clash.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_column).cast("long").alias("id"), F.xxhash64(common.text_column(text_column)).alias("part"))
    joined = rows.join(changed, ["id", "part"], "left")
    return joined.select(
        *[F.coalesce("kept_text", F.col(f"row.`{c}`").cast("string")).alias(c) if c == text_column else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    )
