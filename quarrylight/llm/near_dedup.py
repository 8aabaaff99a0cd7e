"""Near-duplicate documents by min-max hashing.

Every permutation of the shingle codes gives two values, its minimum and its
maximum, so a signature needs half the hash evaluations. Both values of a
permutation agree between two sets with nearly the square of their similarity,
and permutations are independent; a band is ``band_permutations`` of them.

Documents with equal shingle sets are one class. Classes that share a band are
candidates; a link is made only where the full sets, taken anew from the whole
texts, are similar enough. First every class is held against the smallest
class of each of its bands, which finds nearly all links without pairing the
members of a band. A family is what shared bands connect, similar enough or
not. In a family that is still in several components, every class outside its
largest component is searched in an index of the whole family, in blocks, and
only links come out; so no candidate link between components is left out, and
no band, family or candidate list is capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm import common
from quarrylight.llm.common import Scratch, WordCodes, mixed, sequence_codes
from quarrylight.llm.components import components

BANDS, BAND_PERMUTATIONS, SEED = 40, 3, 20240229
#: Classes that can't be named by an id of their own have numbers from here on.
BEYOND = 1 << 62
#: Shingles hashed at once; a longer document is taken in runs of so many.
RUN = 8192
#: Shingles in a block of a family's index: what one task holds at a time.
BLOCK_SHINGLES = 250_000
#: Cells of the sketch that bounds the intersection of two sets from above.
CELLS = 64


def shingle_set(text: bytes | None, size: int, codes: WordCodes) -> np.ndarray:
    """Sorted distinct codes of the ``size``-word shingles of a text, A-Z lower-cased.

    With fewer words the whole sequence is the one shingle; without words the set is empty.
    """
    found = common.words(text.lower() if text else None)
    if not found:
        return np.zeros(0, np.uint64)
    return np.unique(sequence_codes(codes.of(found), min(size, len(found)), odd=min(size, len(found))))


def _multipliers(count: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(SEED)
    return draw.integers(0, 2**63, count, np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 2**63, count, np.uint64)


def bands_of(shingles: np.ndarray, a: np.ndarray, b: np.ndarray, bands: int) -> np.ndarray:
    """A code for each band of the min-max signature of a set."""
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(len(a), np.uint64)
    for at in range(0, len(shingles), RUN):
        values = shingles[at : at + RUN, None] * a + b
        low, high = np.minimum(low, values.min(axis=0)), np.maximum(high, values.max(axis=0))
    total = np.arange(1, bands + 1, dtype=np.uint64) * common.MIX_A
    for part in (*low.reshape(bands, -1).T, *high.reshape(bands, -1).T):
        total = mixed(total * common.MIX_A + part)
    return total


def cells_of(shingles: np.ndarray) -> bytes:
    """How many shingles fall in each cell: the sum of the smaller counts bounds an intersection from above."""
    counts = np.bincount((shingles >> np.uint64(58)).astype(np.int64), minlength=CELLS)
    return counts.astype("<u4").tobytes()


def _signatures(batches: Iterator[pa.RecordBatch], size: int, bands: int, each: int) -> Iterator[pa.RecordBatch]:
    codes, (a, b) = WordCodes(), _multipliers(bands * each)
    for batch in batches:
        for part in common.slices(batch, "text"):
            keys, counts, signatures, cells = [], [], [], []
            for text in common.texts(part):
                found = shingle_set(text, size, codes)
                keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                counts.append(len(found))
                signatures.append(bands_of(found, a, b, bands).view(np.int64) if len(found) else None)
                cells.append(cells_of(found) if len(found) else None)
            yield pa.record_batch(
                [part.column("id"), part.column("part"), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.list_(pa.int64())), pa.array(cells, pa.binary())],
                names=["id", "part", "n_shingles", "set_key", "bands", "cells"],
            )


def _bounded(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs that the counts of their cells don't rule out."""
    for batch in batches:
        left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(-1, CELLS).astype(np.int64) for c in ("cells_u", "cells_v"))
        most = np.minimum(left, right).sum(axis=1)
        union = left.sum(axis=1) + right.sum(axis=1) - most
        yield batch.select(["u", "v"]).filter(pa.array(100 * most >= percent * union))


def _confirmed(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    codes, held, sets = WordCodes(), None, np.zeros(0, np.uint64)
    for batch in batches:
        u, v, linked = batch.column("u").to_pylist(), batch.column("v").to_pylist(), []
        right = batch.column("text_v").cast(pa.binary())
        for i, text in enumerate(batch.column("text_u").cast(pa.binary())):
            if v[i] != held:
                held, sets = v[i], shingle_set(right[i].as_py(), size, codes)
            mine = shingle_set(text.as_py(), size, codes)
            both = len(np.intersect1d(mine, sets, assume_unique=True))
            linked.append(100 * both >= percent * (len(mine) + len(sets) - both))
        yield batch.select(["u", "v"]).filter(pa.array(linked, pa.bool_()))


class _Block:
    """The sets of a block of a family, by shingle; finds those similar to a given set."""

    def __init__(self, ids: list[int], components: list[int], sets: list[np.ndarray]):
        self.ids, self.components = np.array(ids, np.int64), np.array(components, np.int64)
        self.sizes = np.array([len(x) for x in sets], np.int64)
        codes = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(codes, kind="stable")
        self.codes, self.owner = codes[order], np.repeat(np.arange(len(sets)), self.sizes)[order]

    def similar(self, own: np.ndarray, component: int, percent: int) -> np.ndarray:
        low, high = np.searchsorted(self.codes, own, "left"), np.searchsorted(self.codes, own, "right")
        hits = [self.owner[a:b] for a, b in zip(low[high > low], high[high > low], strict=True)]
        both = np.bincount(np.concatenate(hits), minlength=len(self.ids)) if hits else np.zeros(len(self.ids), np.int64)
        near = 100 * both >= percent * (self.sizes + len(own) - both)
        return self.ids[near & (self.components != component)]


def _searched(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Links between asking rows and the held rows of their block; in each block the held rows come first."""
    codes, at, block, held = WordCodes(), None, None, ([], [], [])
    for batch in batches:
        found_u, found_v = [], []
        body = batch.column("text").cast(pa.binary())
        columns = (batch.column(c).to_pylist() for c in ("family", "block", "asks", "id", "component"))
        for i, (family, part, asks, row, component) in enumerate(zip(*columns, strict=True)):
            if at != (family, part):
                at, block, held = (family, part), None, ([], [], [])
            own = shingle_set(body[i].as_py(), size, codes)
            if not asks:
                for kept, value in zip(held, (row, component, own), strict=True):
                    kept.append(value)
                continue
            block = block or _Block(*held)
            near = block.similar(own, component, percent)
            found_u += [row] * len(near)
            found_v += near.tolist()
        yield pa.record_batch([pa.array(found_u, pa.int64()), pa.array(found_v, pa.int64())], names=["u", "v"])


def near_duplicates(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", shingle_words: int = 5,
    percent: int = 80, bands: int = BANDS, band_permutations: int = BAND_PERMUTATIONS, scratch: Scratch | None = None,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    Two documents are linked if ``100 * |intersection| >= percent * |union|``
    of their shingle sets; ``component_id`` is the smallest id reachable and
    ``kept`` marks its own document. A text that is null or has no words has an
    empty set and no links. Rows that repeat an id are each returned with the
    size of their own set, and are one document in links, whatever their texts
    (ids are below 2^62 where one comes with several texts). A row without an id takes no part in links:
    ``component_id`` is null and ``kept`` is true. Other columns are ignored.

    At similarity 0.8 a band agrees with probability of about 0.26, so with 40
    bands a pair shares none with probability of about 5e-6.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "near-dedup")
    text = common.text_column(text_column)
    source = docs.select(F.col(id_column).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("part"))
    signed = scratch.save(
        source.mapInArrow(
            partial(_signatures, size=shingle_words, bands=bands, each=band_permutations),
            "id long, part long, n_shingles long, set_key binary, bands array<long>, cells binary",
        ),
        "signatures",
    )
    named = signed.where("id IS NOT NULL AND set_key IS NOT NULL")
    owned = scratch.save(named.groupBy("set_key").agg(F.min("id").alias("owner"), F.min("n_shingles").alias("n")), "owned")
    # An id that comes with several texts may own several classes: all but one get a number above all ids.
    again = owned.groupBy("owner").agg(F.min("set_key").alias("own_key"), F.count("*").alias("classes")).where("classes > 1").select("owner", "own_key")
    beyond = F.lit(BEYOND).bitwiseOR(F.xxhash64("set_key").bitwiseAND(F.lit(BEYOND - 1)))
    classes = scratch.save(
        owned.join(again, "owner", "left").select("set_key", "owner", "n", F.when(F.col("own_key") != F.col("set_key"), beyond).otherwise(F.col("owner")).alias("class")), "classes"
    )
    first = (
        named.select(F.col("id").alias("owner"), "part", "set_key", "bands", "cells")
        .join(classes, ["owner", "set_key"])
        .dropDuplicates(["owner", "set_key"])
    )
    sketches = scratch.save(first.select(F.col("class").alias("id"), "owner", "part", "n", "cells", "bands"), "sketches")
    buckets = sketches.select("id", F.explode("bands").alias("band"))
    hubs = buckets.groupBy("band").agg(F.min("id").alias("hub"), F.count("*").alias("members")).where("members > 1")
    shared = scratch.save(buckets.join(hubs.select("band", "hub"), "band"), "shared")

    candidates = scratch.save(shared.where("id != hub").select(F.col("id").alias("u"), F.col("hub").alias("v")).distinct(), "candidates")

    small = sketches.select("id", "n", "cells")
    sized = (
        candidates.join(small.toDF("u", "n_u", "cells_u"), "u").join(small.toDF("v", "n_v", "cells_v"), "v")
        .where(f"100 * least(n_u, n_v) >= {percent} * greatest(n_u, n_v)")
    )
    likely = scratch.save(sized.mapInArrow(partial(_bounded, percent=percent), "u long, v long"), "likely")
    # The texts of all candidates move once, for both searches.
    wanted = candidates.select(F.col("u").alias("id")).union(candidates.select(F.col("v").alias("id"))).distinct()
    # Candidates grow with the corpus, so both sides are shuffled at every size.
    places = sketches.select("id", F.col("owner").alias("of"), F.col("part").alias("of_part")).join(wanted, "id").hint("merge")
    found = source.select(F.col("id").alias("of"), F.col("part").alias("of_part"), "text").join(places, ["of", "of_part"])
    bodies = scratch.save(found.groupBy("id").agg(F.min("text").alias("text")), "bodies")
    starred = likely.join(bodies.toDF("u", "text_u"), "u").join(bodies.toDF("v", "text_v"), "v").select("u", "v", "text_u", "text_v")
    links = scratch.save(starred.mapInArrow(partial(_confirmed, size=shingle_words, percent=percent), "u long, v long"), "stars")
    scratch.drop("likely")
    joined = components(links, scratch, "first")

    # Families: what shared bands connect at all. Those that still hold several components are searched within.
    families = components(candidates, scratch, "families").toDF("id", "family")
    placed = scratch.save(
        families.join(joined.toDF("id", "component"), "id", "left").join(sketches.select("id", "n"), "id")
        .select("id", "family", F.coalesce("component", "id").alias("component"), "n"),
        "placed",
    )
    parts = placed.groupBy("family", "component").agg(F.count("*").alias("members"), F.sum("n").alias("n"))
    split = scratch.save(
        parts.groupBy("family")
        .agg(F.max(F.struct("members", -F.col("component"))).alias("largest"), F.count("*").alias("parts"), F.sum("n").alias("n"))
        .where("parts > 1")
        .select("family", (-F.col("largest.col2")).alias("main"), F.ceil(F.col("n") / BLOCK_SHINGLES).alias("blocks")),
        "split",
    )
    inside = placed.join(split, "family")
    rows = scratch.save(inside.join(bodies, "id"), "inside")
    held = rows.select("family", F.pmod(F.xxhash64("id"), "blocks").alias("block"), F.lit(False).alias("asks"), "id", "component", "text")
    asked = rows.where("component != main").select(
        "family", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("asks"), "id", "component", "text"
    )
    more = scratch.save(
        held.union(asked).repartition("family", "block").sortWithinPartitions("family", "block", "asks")
        .mapInArrow(partial(_searched, size=shingle_words, percent=percent), "u long, v long"),
        "across",
    )
    # The classes of an id's texts belong together.
    several = named.groupBy("id").agg(F.min("set_key").alias("low"), F.max("set_key").alias("high")).where("low != high").select("id")
    held = named.select("id", "set_key").join(several, "id", "left_semi").distinct().join(classes.select("set_key", "class"), "set_key")
    within = held.join(held.groupBy("id").agg(F.min("class").alias("v")), "id").select(F.col("class").alias("u"), "v")
    final = components(joined.toDF("u", "v").union(more).union(within), scratch, "last")
    scratch.drop("shared", "bodies", "candidates", "stars", "placed", "split", "inside", "sketches")

    member = (
        classes.join(final.withColumnRenamed("node", "class"), "class", "left")
        .select("set_key", F.coalesce("component", "class").alias("component_id"))
    )
    # A row without words takes the component that its id has by another text, if any.
    empty = signed.where("set_key IS NULL").select("id", "n_shingles")
    other = named.select("id", "set_key").join(empty.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min("set_key").alias("set_key"))
    rows = signed.where("set_key IS NOT NULL").select("id", "n_shingles", "set_key").unionByName(empty.join(other, "id", "left"))
    out = rows.join(member, "set_key", "left")
    mine = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(
        F.col("id").alias("doc_id"), "n_shingles", mine.alias("component_id"), F.coalesce(mine == F.col("id"), F.lit(True)).alias("kept")
    )


def one_of_each(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, without the near duplicates of documents of smaller id.

    Of rows that repeat an id the one of smallest text stays, null first, of
    equal texts the one of smallest row hash; rows without an id all stay.
    """
    judged = near_duplicates(docs, id_column=id_column, text_column=text_column, shingle_words=shingle_words, percent=percent)
    kept = judged.where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("kept_id")).distinct()
    # One struct beside the rows, so no column name can clash.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_column).cast("long").alias("id"))
    order = Window.partitionBy("id").orderBy(F.col("row")[text_column].asc_nulls_first(), F.xxhash64("row"))
    named = rows.join(kept, rows.id == kept.kept_id, "left_semi").withColumn("at", F.row_number().over(order)).where("at = 1").select("row", "id")
    return named.union(rows.where("id IS NULL")).select("row.*")
