"""Connected components of a graph of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import stored


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Links u > v in, links u > v out. Large: every larger neighbour of a node is tied to the node's least neighbour.
    Small: every smaller neighbour, and the node, are tied to the least of them."""
    if large:
        pairs = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    joined = pairs.join(least, pairs.u == least.k)
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
    return out.where(F.col("u") > F.col("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of the links (a, b): root is the least node of its component.

    Each round costs a few shuffles of the links; the rounds grow with the logarithm of the nodes. Written tables cut the
    lineage. Links of a node to itself and repeated links change nothing; no links give no rows.
    """
    pairs = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        said = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if said == before or not said[0]:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = said
        pairs = stored(_star(_star(pairs, True), False), "links")
