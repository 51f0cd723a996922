"""Connected components of a link table, as a sequence of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwatch.llm.common import written


def _star(pairs: DataFrame, high: str, low: str) -> DataFrame:
    """Distinct links from the larger to the smaller node, without loops."""
    a, b = F.col(high), F.col(low)
    ordered = pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    return ordered.where("u <> v").distinct()


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """``node, root``: every linked node with the smallest node it can reach.

    Alternating stars: each node hands its larger neighbours, then all its smaller ones, to the
    smallest neighbour, until every component is a star around its root.  Minima are combined
    before the shuffle, so a node with very many links is no hot key.  Every round is written to
    the shared folder; the driver sees a row count and a checksum.
    """
    edges = written(_star(links, left, right))
    seen = None
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        low = low.select("u", F.least("u", "m").alias("m"))
        large = _star(both.where("v > u").join(low, "u"), "v", "m")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edges = written(_star(small.select("v", "m").union(low.select("u", "m")), "v", "m"))
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(30,0)"))).first()
        if mark == seen:
            break
        seen = mark
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
