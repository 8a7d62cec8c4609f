"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.session import stage_counted


def _staged(edges: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    mark = F.sum(F.xxhash64("a", "b").bitwiseAND((1 << 40) - 1))
    back, seen = stage_counted(edges, {"rows": F.count(F.lit(1)), "mark": mark}, "stars")
    return back, (seen["rows"], seen["mark"] or 0)


def components(links: DataFrame) -> DataFrame:
    """``links``: two columns of long ids. Returns (node, component), one row per linked id; the component is its smallest id.

    In a large star every larger neighbour of a node, in a small star every smaller one, is
    hung on the node's smallest neighbour, until each component is one star. A
    node's smallest neighbour is a combined aggregate and the joins can be split by the
    planner, so one node may have any share of the links. Every round is a written table.
    """
    a, b = links.columns
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    edges, mark = _staged(edges)
    while mark[0]:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large, _ = _staged(large)
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(smallest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionAll(smallest.select("a", F.col("m").alias("b"))).distinct()
        )
        edges, now = _staged(small)
        if now == mark:
            break
        mark = now
    roots = edges.select("b").distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        roots.select(F.col("b").alias("node"), F.col("b").alias("component"))
    )
