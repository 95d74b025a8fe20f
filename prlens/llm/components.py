"""Connected components of a link table by alternating star contraction.

Each round is two grouped minima and two joins on node ids; the links are
written to the shared folder after each round.  The largest neighbourhood is
never gathered: a hub only sends its minimum.  Rounds grow with the logarithm
of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prlens.llm.common import stored


def _state(links: DataFrame):
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b: long); the component
    is the smallest node reachable.  Loops, repeats and nulls are ignored."""
    e = (links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    e = stored(e, "links")
    state = _state(e)
    while state[0]:
        both = e.union(e.select("v", "u"))
        # Written, so that both sides of the join are plain exchanges and a hub's rows can be split.
        low = stored(both.groupBy("u").agg(F.min("v").alias("m"))
                     .select(F.col("u").alias("w"), F.least("u", "m").alias("m")), "minima")
        large = (both.join(low, both.u == low.w).filter("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        small = large.join(low, large.u == low.w).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(small.union(low.select("w", "m")).distinct(), "links")
        before, state = state, _state(e)
        if state == before:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select("v", "v").distinct())
