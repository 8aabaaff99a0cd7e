"""Per-group top-n and numbering that hold when one group is very large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(
    df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank",
    spread: list[str] | None = None, salts: int = 8,
) -> DataFrame:
    """First ``n`` rows of each group.

    With a literal bound the planner keeps only ``n`` rows per group and input
    partition before it shuffles, so a hot group sends few rows to its task.
    Where a join on the keys comes just before, that join has already brought
    the group together: ``spread`` columns then make a first cut in hashed
    slices, which lets adaptive execution split the hot side of the join.
    """
    if spread:
        cut = F.pmod(F.xxhash64(*spread), F.lit(salts))
        df = top_n(df.withColumn("_slice", cut), [*keys, "_slice"], order, n, "_cut").drop("_slice", "_cut")
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w).cast("long")).where(F.col(rank) <= n)


def top_n_by(
    df: DataFrame, keys: list[str], order: list[Column], n: Column, spread: list[str],
    rank: str = "rank", salts: int = 64,
) -> DataFrame:
    """As :func:`top_n`, for a bound that differs per group.

    A first cut is taken in ``salts`` slices of each group (by the hash of the
    ``spread`` columns), the final one over what is left: at most ``salts * n``
    rows of a group meet in one task.
    """
    slice_ = F.pmod(F.xxhash64(*spread), F.lit(salts))
    first = Window.partitionBy(*keys, "_slice").orderBy(*order)
    last = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_slice", slice_)
        .withColumn("_n", n)
        .withColumn("_r", F.row_number().over(first))
        .where("_r <= _n")
        .withColumn(rank, F.row_number().over(last).cast("long"))
        .where(F.col(rank) <= F.col("_n"))
        .drop("_slice", "_n", "_r")
    )


def hashed_position(df: DataFrame, key: Column, name: str = "position") -> DataFrame:
    """Number all rows 0, 1, 2 ... by ``md5(key)`` without one global sort.

    Rows are numbered inside 4,096 slices of the hash space; the offsets of the
    slices come from a table of at most 4,096 counts.
    """
    marked = df.withColumn("_md5", F.md5(key.cast("string").cast("binary"))).withColumn(
        "_slice", F.substring("_md5", 1, 3)
    )
    counts = marked.groupBy("_slice").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_slice", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_slice").orderBy("_md5")
    return (
        marked.withColumn("_rn", F.row_number().over(inside))
        .join(F.broadcast(offsets), "_slice")  # never more than 4,096 rows
        .withColumn(name, (F.col("_offset") + F.col("_rn") - 1).cast("long"))
        .drop("_md5", "_slice", "_rn", "_offset")
    )


def numbered(
    df: DataFrame, keys: list[str], value: str, low: Column, high: Column, name: str = "position", slices: int = 4096
) -> DataFrame:
    """Number the rows of each group 0, 1, 2 ... by an integer column without nulls.

    Rows are numbered inside ``slices`` ranges of the values between ``low`` and
    ``high``, so that a hot group is dealt over many tasks; a group's offsets sum
    its range counts, at most ``slices`` of them. Values outside the bounds go
    to the outer ranges. Equal values of a group come in any order.
    """
    share = (F.col(value).cast("double") - low) / (high - low + F.lit(1.0))
    place = F.least(F.greatest(F.floor(share * slices), F.lit(0)), F.lit(slices - 1))
    marked = df.withColumn("_slice", F.coalesce(place, F.lit(0)).cast("int"))
    counts = marked.groupBy(*keys, "_slice").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_slice", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(value)
    return (
        marked.withColumn("_rn", F.row_number().over(inside)).join(offsets, [*keys, "_slice"])
        .withColumn(name, (F.col("_offset") + F.col("_rn") - 1).cast("long"))
        .drop("_slice", "_rn", "_offset")
    )
