"""Connected components by alternating large-star and small-star rounds.

Kiveris et al., "Connected Components in MapReduce and Beyond" (SoCC 2014). Every
round is two grouped minima and two equi-joins on vertex ids; a hub's rows meet its
minimum in a join whose other side has one row a vertex. The minima are cut off first:
with a plain exchange on either side Spark can split a hub's partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clear, cut, marked


def _large_star(edges: DataFrame) -> DataFrame:
    """Each vertex links its larger neighbours to its smallest neighbour."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return (
        both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex links its smaller neighbours and itself to the smallest of them.
    ``edges`` hold u > v."""
    least = cut(edges.groupBy("u").agg(F.min("v").alias("m")))
    moved = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) undirected links -> (node, root), root the smallest node reachable.

    Nodes without a link to another node are not listed; self links and repeated links
    are ignored; an empty input gives an empty result.
    """
    spark = edges.sparkSession
    now = cut(
        edges.filter("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    before, since = _state(now), marked()
    for _ in range(max_rounds):
        now = cut(_small_star(_large_star(now)))
        clear(spark, since, but=1)  # what the round before has left
        after = _state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
