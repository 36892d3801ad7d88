"""Connected components by alternating large-star and small-star steps, wholly on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normloom.llm.shared import reliable


def _smallest(pairs: DataFrame) -> DataFrame:
    """Per ``u`` the smallest neighbour. Grouping by ``u`` and a digit of it gives a layout that the
    join back to ``u`` cannot reuse, so both of its sides are exchanged and a hot ``u`` can be split."""
    low = pairs.withColumn("digit", F.pmod("u", F.lit(7))).groupBy("u", "digit").agg(F.min("v").alias("least"))
    return low.select("u", F.least("u", "least").alias("least"))


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for all nodes of ``edges(u, v)``; the component is its smallest node.

    Self loops and repeated edges do no harm; nodes without a link to another node are not returned.
    Each round rewrites the edges by two star steps and keeps them in the shared checkpoint folder.
    It ends when a round changes no edge: then all nodes hang on their smallest node.
    """
    clean = edges.where("u is not null and v is not null and u != v")
    state = reliable(clean.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.where("v > u").join(_smallest(both), "u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u != v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = _smallest(down)
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(least.select("u", F.col("least").alias("v")))
        state = reliable(small.where("u != v").distinct())
        now = state.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if mark == (now.n, now.x):
            break
        mark = (now.n, now.x)
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
