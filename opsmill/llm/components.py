"""Connected components of a table of links, by rounds of large and small stars.

In every round each node hands its larger neighbours, then its smaller ones, to the
smallest node it knows. Chains halve from round to round, so that the number of rounds
grows with the logarithm of the longest one. All rounds are aggregations and joins of
link tables; a node with very many links is pre-aggregated before its rows meet, and
Spark splits its side of the join. Rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsmill.llm.common import written


def _state(edges: DataFrame) -> tuple:
    """Two tables of links that agree in this hold the same links."""
    return tuple(
        edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))
        ).first()
    )


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest reachable node) of all nodes that ``links`` (a, b) join.

    Nodes that are alone don't occur. Links may repeat and may join a node to itself.
    """
    edges = written(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(),
        "links",
    )
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # A node whose neighbours are all smaller keeps its link to the smallest.
        large = large.unionByName(least.filter("m < u").select("u", F.col("m").alias("v"))).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "links")
        before, state = state, _state(edges)
        if state == before:
            break
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    heads = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionByName(heads)
