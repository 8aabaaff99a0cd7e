"""Connected components of a table of links, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import Scratch


def _lowest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to the smallest node around u."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _lowest(both).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked to the smallest of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _lowest(down)
    moved = down.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def _mark(links: DataFrame) -> tuple:
    row = links.agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
    ).first()
    return row["n"], row["h"]


def components(links: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """(node, component): the smallest node reachable from each node of ``links`` (u, v).

    Only counts and a checksum reach the driver. Minima are partial aggregates
    and joins are left to adaptive execution, so a node with very many links is
    not one task's work.
    """
    state = scratch.save(links.where("u != v").select("u", "v").distinct(), f"{label}-0")
    mark, step = _mark(state), 0
    while mark[0]:
        step += 1
        state = scratch.save(_small_star(_large_star(state)), f"{label}-{step}")
        scratch.drop(f"{label}-{step - 1}")
        last, mark = mark, _mark(state)
        if mark == last:
            break
    return state.select(F.col("u").alias("node"), F.col("v").alias("component"))
