"""Nearest neighbours by collision counting on sorted projections.

The vectors of a block are split into length classes: in each, no vector is
``CLASS_RATIO`` times as long as another. A class is lifted on the sphere of
its own longest vector (inner products then order as distances do) and
projected on single directions, orthogonal in sets of as many as there are
dimensions. Its vectors are sorted by each projection. A query's windows,
centred on its own projections, widen from radius to radius (virtual
rehashing: nothing is hashed anew); radii are multiples of the spread of the
class along the projection. A vector counts a collision for every window it
lies in. A query verifies all vectors that reach its collision threshold: the
highest one that lets ``verify_share`` of the class and the wanted number
through, and ``LEAST_VERIFIED`` at least. Verified vectors are ranked by their
exact inner products in double precision.

Every vector is in one block and every query visits every block, and in it the
classes from the longest down, but for those whose longest vector times the
query's length falls short of the last score it has found. Blocks are a fixed
number of vectors, so a task holds one block whatever the table's size.
"""

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm.common import Scratch

#: Projections at least: as many orthogonal sets as that takes.
PROJECTIONS, SEED = 64, 4242
#: Half widths of the windows in standard deviations of a class along the projection.
RADII = (0.5, 1.0, 1.5, 2.0)
VERIFY_SHARE, BLOCK_ROWS = 0.1, 16_384
#: Longest to shortest vector of a length class at most; vectors of a class that are verified at least, the first by collisions.
CLASS_RATIO, LEAST_VERIFIED = 1.2, 256


def directions(dimensions: int, least: int = PROJECTIONS) -> np.ndarray:
    """Columns are projection directions: random orthogonal bases, scaled to unit variance, ``least`` directions at least."""
    draw = np.random.default_rng(SEED)
    bases = [np.linalg.qr(draw.standard_normal((dimensions, dimensions)))[0] for _ in range(-(-least // dimensions))]
    return np.concatenate(bases, axis=1) * np.sqrt(dimensions)


def lengths(vectors: np.ndarray) -> np.ndarray:
    """Lengths of vectors, also where squares leave the range of doubles."""
    scale = np.abs(vectors).max(axis=1, keepdims=True)
    return scale[:, 0] * np.sqrt(((vectors / scale) ** 2).sum(axis=1))


class LengthClass:
    """Vectors of about one length, sorted by each projection; ``rows`` are their places in the block."""

    def __init__(self, rows: np.ndarray, vectors: np.ndarray, norms: np.ndarray, radii: tuple[float, ...], verify_share: float):
        self.rows, self.radii, self.share, self.longest = rows, radii, verify_share, float(norms.max())
        if len(rows) <= LEAST_VERIFIED:
            return
        rest = np.sqrt(np.maximum(1 - (norms / self.longest) ** 2, 0))
        self.directions = directions(vectors.shape[1] + 1)
        projected = np.column_stack((vectors / self.longest, rest)) @ self.directions
        self.spread = projected.std(axis=0)
        self.orders = np.argsort(projected, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(projected.T, self.orders, axis=1)

    def collisions(self, units: np.ndarray) -> Iterator[np.ndarray]:
        """For each query, given at length one, the collisions of every vector, over all projections and radii."""
        centre = np.column_stack((units, np.zeros(len(units)))) @ self.directions
        widths = np.array((*(-r for r in self.radii[::-1]), *self.radii))
        edges = np.stack([np.searchsorted(own, centre[:, j, None] + widths * self.spread[j]) for j, own in enumerate(self.sorted)])
        # A ring between two radii lies in all wider windows.
        gains = [*range(1, len(self.radii) + 1), *range(len(self.radii) - 1, 0, -1)]
        for q in range(len(units)):
            counts = np.zeros(len(self.rows), np.int32)
            for order, cut in zip(self.orders, edges[:, q].tolist(), strict=True):
                for low, high, gain in zip(cut, cut[1:], gains, strict=False):
                    if low < high:
                        counts[order[low:high]] += gain
            yield counts

    def candidates(self, units: np.ndarray, k: int) -> Iterator[np.ndarray]:
        """For each query the rows to verify."""
        enough = max(LEAST_VERIFIED, k + 1 + int(np.ceil(self.share * len(self.rows))))
        if enough >= len(self.rows):
            for _ in units:
                yield self.rows
            return
        for counts in self.collisions(units):
            yield self.rows[counts >= np.partition(counts, -enough)[-enough]]


class Block:
    """The vectors of a block in length classes, the longest first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, radii: tuple[float, ...], verify_share: float):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        norms = lengths(self.vectors)
        self.classes = []
        left = np.argsort(-norms, kind="stable")
        while len(left):
            # Each class starts at the longest vector left, so lengths that are equal but for rounding are one class.
            rows = left[: np.searchsorted(-norms[left], -norms[left[0]] / CLASS_RATIO, side="right")]
            left = left[len(rows) :]
            rows = np.sort(rows)
            self.classes.append(LengthClass(rows, self.vectors[rows], norms[rows], radii, verify_share))

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, ids, scores) of the k nearest of the verified vectors, other than the query's own row."""
        length = lengths(queries)
        units = queries / length[:, None]
        best, scores = [np.zeros(0, np.int64)] * len(queries), [np.zeros(0)] * len(queries)
        for part in self.classes:
            # No vector of the class scores more than the product of the lengths; a little more for rounding.
            bound = part.longest * length * (1 + 1e-9)
            asking = np.array([q for q in range(len(queries)) if len(best[q]) < k or bound[q] >= scores[q][-1]], np.int64)
            for q, found in zip(asking, part.candidates(units[asking], k), strict=True):
                found = found[self.ids[found] != query_ids[q]]
                rows = np.concatenate((best[q], found))
                values = np.concatenate((scores[q], (self.vectors[found] * queries[q]).sum(axis=1)))
                chosen = np.lexsort((self.ids[rows], -values))[:k]
                best[q], scores[q] = rows[chosen], values[chosen]
        for query, rows, values in zip(query_ids, best, scores, strict=True):
            yield query, self.ids[rows], values


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _searched(batches: Iterator[pa.RecordBatch], k: int, radii: tuple[float, ...], verify_share: float) -> Iterator[pa.RecordBatch]:
    """Sorted by block, the block's vectors (``asks`` false) before its queries."""
    at, block, ids, vectors = None, None, [], []
    for batch in batches:
        numbers = batch.column("block").to_numpy()
        asks = batch.column("asks").to_numpy(zero_copy_only=False)
        rows, matrix = batch.column("vec_id").to_numpy(), _matrix(batch.column("vector"))
        edges = np.flatnonzero((numbers[1:] != numbers[:-1]) | (asks[1:] != asks[:-1])) + 1
        for low, high in zip((0, *edges), (*edges, len(numbers)), strict=True):
            if low == high:
                continue
            if numbers[low] != at:
                at, block, ids, vectors = numbers[low], None, [], []
            if not asks[low]:
                ids.append(rows[low:high])
                vectors.append(matrix[low:high])
                continue
            if not ids:
                continue
            block = block or Block(np.concatenate(ids), np.concatenate(vectors), radii, verify_share)
            found = list(block.nearest(rows[low:high], matrix[low:high], k))
            yield pa.record_batch(
                [
                    pa.array(np.repeat([q for q, _, _ in found], [len(x) for _, x, _ in found]).astype(np.int64)),
                    pa.array(np.concatenate([x for _, x, _ in found])), pa.array(np.concatenate([s for _, _, s in found])),
                ],
                names=["query_id", "vec_id", "score"],
            )


def nearest_neighbours(
    table: DataFrame, is_query, *, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding",
    radii: tuple[float, ...] = RADII, verify_share: float = VERIFY_SHARE, block_rows: int = BLOCK_ROWS, scratch: Scratch | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows found of largest inner product with each row that ``is_query`` picks.

    Ranks start at 1, ties go to the smaller id; a query's own row is no
    candidate, an equal vector of another row is. All candidates are returned
    if there are fewer than ``k``. Rows without an id, and vectors that are
    null, empty, zero or hold null or non-finite numbers, take no part; a table
    may hold one length of vector only (others are an error). Rows that repeat
    an id are one row, with the smallest of their vectors. Other columns are ignored.
    """
    spark = table.sparkSession
    scratch = scratch or Scratch(spark, "neighbours")
    vector = F.col(vector_column).cast("array<double>")
    sound = vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    rows = (
        table.where(F.col(id_column).isNotNull() & sound)
        .select(F.col(id_column).cast("long").alias("vec_id"), vector.alias("vector"), is_query.alias("asks"))
        .groupBy("vec_id").agg(F.min("vector").alias("vector"), F.max("asks").alias("asks"))
    )
    rows = scratch.save(rows, "vectors")
    shape = rows.agg(F.count("*").alias("n"), F.min(F.size("vector")).alias("low"), F.max(F.size("vector")).alias("high")).first()
    if shape["n"] and shape["low"] != shape["high"]:
        raise ValueError(f"vectors of {shape['low']} and of {shape['high']} numbers")
    blocks = max(1, -(-shape["n"] // block_rows))
    held = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"), F.lit(False).alias("asks"), "vec_id", "vector")
    asked = rows.where("asks").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(True).alias("asks"), "vec_id", "vector")
    found = scratch.save(
        held.union(asked).repartitionById(blocks, F.col("block").cast("int")).sortWithinPartitions("block", "asks")
        .mapInArrow(partial(_searched, k=k, radii=radii, verify_share=verify_share), "query_id long, vec_id long, score double"),
        "found",
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
