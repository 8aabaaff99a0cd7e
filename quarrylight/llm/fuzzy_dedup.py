"""Near-duplicate documents by SimHash fingerprints and Golay-code fuzzy hashing.

A 64-bit fingerprint falls into three segments. Of two fingerprints that differ
in at most two bits, one segment at least has no error, and the segment after it
has at most two, which the Golay keys bear (see ``golay``). So a key is a
segment as it is, with one of the few codewords around the next segment, and
near fingerprints share a key with certainty.

Equal fingerprints are one class before keys are made. In a bucket of a few
classes all are compared in the join. The classes of larger buckets are linked
through the words halfway: each is listed under itself and its 64 one-bit
neighbours; whatever meets there is within two bits of each other, and no such
place can hold more than 65 fingerprints. So no bucket is capped, none is
paired off, and every link between components is found.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm import common
from quarrylight.llm.common import Scratch
from quarrylight.llm.components import components
from quarrylight.llm.golay import fuzzy_keys

#: The segments of a fingerprint: lowest bit and width.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints that differ in more bits are no link; the Golay keys bear no more.
MOST_BITS = 2
#: Classes of a bucket that are compared with each other; larger buckets go through the words halfway.
COMPARED = 32
SEED = 42
#: Shingle hashes whose bits are counted at once.
RUN = 16384


def fingerprint(text: bytes | None, size: int) -> int:
    """The majority of each bit over the XXH64 hashes of all ``size``-word shingles, A-Z lower-cased; 0 without words."""
    found = common.words(text.lower() if text else None)
    if not found:
        return 0
    joined, size, digest = b" ".join(found), min(size, len(found)), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(found) - size + 1].tolist()
    stops = (ends - 1)[size - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), RUN):
        part = [digest(joined[a:b], SEED) for a, b in zip(starts[at : at + RUN], stops[at : at + RUN], strict=True)]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in common.slices(batch, "text"):
            found = np.array([fingerprint(t, size) for t in common.texts(part)], np.uint64).view(np.int64)
            yield pa.record_batch([part.column("id"), pa.array(found)], names=["id", "bits"])


def segment_keys(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): a segment as it is, beside a codeword near the next one, for each of the three segments."""
    rows, keys = [], []
    for k, (low, width) in enumerate(SEGMENTS):
        after, after_width = SEGMENTS[(k + 1) % len(SEGMENTS)]
        exact = bits >> np.uint64(low) & np.uint64((1 << width) - 1)
        row, index = fuzzy_keys(bits >> np.uint64(after) & np.uint64((1 << after_width) - 1), after_width)
        rows.append(row)
        keys.append((np.uint64(k) << np.uint64(34)) | (exact[row] << np.uint64(12)) | index.astype(np.uint64))
    return np.concatenate(rows), np.concatenate(keys).view(np.int64)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, key = segment_keys(batch.column("bits").to_numpy().view(np.uint64))
        yield pa.record_batch([pa.array(key), batch.column("bits").take(pa.array(row)), batch.column("class").take(pa.array(row))], names=["key", "bits", "class"])


def fingerprint_links(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (u, v) between classes (bits, class) that connect just the fingerprints within two bits of each other.

    ``bits`` must be distinct. Within a large bucket the links form a star around
    each word halfway instead of all pairs; what is connected is the same.
    """
    keyed = scratch.save(classes.select("bits", "class").mapInArrow(_keyed, "key long, bits long, class long"), "keys")
    met = keyed.join(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")
    met = scratch.save(met, "met")
    few = met.where(F.col("n") <= COMPARED)
    near = F.bit_count(F.col("a.bits").bitwiseXOR(F.col("b.bits"))) <= MOST_BITS
    pairs = few.alias("a").join(few.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.bits") < F.col("b.bits")) & near)
    links = pairs.select(F.col("a.class").alias("u"), F.col("b.class").alias("v"))

    halves = F.array(*[F.lit(v) for v in [0, *np.left_shift(1, np.arange(64, dtype=np.int64)).tolist()]])
    many = met.where(F.col("n") > COMPARED).select("bits", "class").distinct()
    places = scratch.save(many.select("class", "bits", F.explode(halves).alias("flip")).select("class", F.col("bits").bitwiseXOR(F.col("flip")).alias("place")), "places")
    heads = places.groupBy("place").agg(F.min("class").alias("v"), F.count("*").alias("n")).where("n > 1")
    stars = places.join(heads, "place").select(F.col("class").alias("u"), "v").where("u != v")
    return links.union(stars).distinct()


def fuzzy_duplicates(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", shingle_words: int = 3, scratch: Scratch | None = None,
) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs``.

    ``fingerprint`` is 16 lower-case hex digits; texts that are null or have no
    words have fingerprint zero, which links like any other. Documents are
    linked if their fingerprints differ in at most two bits; ``component_id`` is
    the smallest id reachable. Rows that repeat an id are each returned with
    their own fingerprint, and are one document in links, whatever their texts.
    A row without an id takes no part in links; its ``component_id`` is null.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "fuzzy-dedup")
    source = docs.select(F.col(id_column).cast("long").alias("id"), common.text_column(text_column).alias("text"))
    signed = scratch.save(source.mapInArrow(partial(_fingerprints, size=shingle_words), "id long, bits long"), "fingerprints")
    named = signed.where("id IS NOT NULL")
    classes = scratch.save(named.groupBy("bits").agg(F.min("id").alias("class")), "classes")
    # An id with several fingerprints holds their classes together.
    several = named.groupBy("id").agg(F.min("bits").alias("low"), F.max("bits").alias("high")).where("low != high").select("id")
    held = named.join(several, "id", "left_semi").distinct().join(classes, "bits").select("id", "class")
    within = held.join(held.groupBy("id").agg(F.min("class").alias("v")), "id").select(F.col("class").alias("u"), "v")
    links = fingerprint_links(classes, scratch).union(within)
    final = components(links, scratch, "links")
    scratch.drop("keys", "met", "places")
    member = classes.join(final.withColumnRenamed("node", "class"), "class", "left").select("bits", F.coalesce("component", "class").alias("component_id"))
    shown = F.lower(F.lpad(F.hex("bits"), 16, "0"))
    return signed.join(member, "bits", "left").select(
        F.col("id").alias("doc_id"), shown.alias("fingerprint"), F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id")
    )
