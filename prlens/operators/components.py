"""Connected components of a link table by alternating star contraction.

Each round replaces a node's links by links to the smallest neighbour: first
those to larger neighbours, then those to smaller ones.  A round is two
grouped minima and two joins, written to the shared folder; no neighbourhood
is gathered, and the rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prlens.session import written


def _hooked(links: DataFrame, larger: bool) -> DataFrame:
    """Each node's neighbours on one side linked to the node's smallest neighbour (itself included)."""
    if larger:
        links = links.union(links.select("b", "a"))
    low = links.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    met = links.join(low.hint("shuffle_merge"), F.col("a") == F.col("n"))
    if larger:
        return met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    return (met.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low.select("n", "m")).distinct())


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b: any type with an order);
    the component is its smallest node.  Loops, repeats and nulls are ignored."""
    links = written(links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                    .distinct(), "links")

    def state(e):
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    now = state(links)
    while now[0]:
        links = written(_hooked(_hooked(links, True), False), "links")
        before, now = now, state(links)
        if now == before:
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select("b", "b").distinct())
