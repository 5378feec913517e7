"""Connected components by alternating large-star and small-star steps, all as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulspark.llm.common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, component) for every end of ``edges`` (a, b: long); component is the smallest node reachable.

    Each round points every node at the smallest node it knows of, first among its larger neighbours and then
    among its smaller ones, until each component is a star around its smallest node; the number of rounds
    grows with the logarithm of the longest path. Each round is a table in the shared folder, and only two
    numbers of it come to the driver. Loops and repeated edges do no harm; null ends are ignored; no edges
    give no rows.
    """
    now = scratch.save(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0"
    )
    state = _state(now)
    k = 0
    while state[0]:
        k += 1
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = scratch.save(small.union(low).distinct(), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        now, before, state = after, state, _state(after)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]
