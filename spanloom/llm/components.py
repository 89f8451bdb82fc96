"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before its shuffle) and an equi-join that adaptive execution can
split, so a hub with a third of all edges stays spread out. Nothing but two numbers a round reaches the driver. Tables
shrink from round to round, so each is written in as many files as the last one's rows call for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


#: Edges of a file, 16 bytes each.
ROWS = 1_000_000


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"] or 0


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(vertex, component) for every vertex with an edge; the component is its smallest vertex.

    ``edges`` has two long columns ``a`` and ``b``; rows with a null end, loops and repeats are ignored.
    """
    now = scratch.save(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        few=True,
    )
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        after = scratch.save(small.coalesce(1 + mark[0] // ROWS))
        scratch.drop(now)
        now, was, mark = after, mark, _mark(after)
        if mark == was:
            break
    roots = now.select(F.col("v").alias("vertex")).distinct().withColumn("component", F.col("vertex"))
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(roots)
