"""Connected components of an edge list by alternating stars.

Each round hangs every node's larger neighbours on its smallest one, then its
smaller neighbours, until the edges are stars around each component's smallest
node.  Rounds are joins and minima over the edge list (partial aggregation), each
written as a table, so no component, however large, meets in one task or on the
driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) that is not its component's
    smallest one; ids are longs."""
    def keep(df: DataFrame, step: str) -> DataFrame:
        return scratch.keep(df, f"{name}-{step}")

    def facts(df: DataFrame):
        r = df.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        return tuple(r)

    e = keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "e0")
    seen, round_ = facts(e), 0
    while seen[0]:
        round_ += 1
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"l{round_}")
        large = keep(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(),
                     f"g{round_}")
        low2 = keep(large.groupBy("u").agg(F.min("v").alias("m")), f"s{round_}")
        hung = large.join(low2, "u")
        new = hung.select("u", F.col("m").alias("v")) \
            .unionByName(hung.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        new = keep(new, f"e{round_}")
        now = facts(new)
        scratch.drop(*(f"{name}-{s}{round_}" for s in "lgs"), f"{name}-e{round_ - 1}")
        e, done = new, now == seen
        seen = now
        if done:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
