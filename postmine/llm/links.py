"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmine.llm.rows import settle


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root``, the least node that links lead to, for every node that has a link.

    Stars are drawn towards the least neighbour in turns, from above and from below, until nothing changes. Every turn
    is written to the shared folder; the driver sees one sum of hashes per turn. Nulls and loops are left out.
    """
    x, y = F.col(a).alias("x"), F.col(b).alias("y")
    edges = links.select(x, y).filter("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
    edges = settle(edges, "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        # Every larger neighbour of x goes to the least one of x.
        large = both.join(least, "x").filter("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).filter("x <> y").distinct()
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(least, "x").select(F.explode(F.array(F.struct("x", F.col("m").alias("y")), F.struct(F.col("y").alias("x"), F.col("m").alias("y")))).alias("e"))
        edges = settle(small.select("e.x", "e.y").filter("x <> y").distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.groupBy("x").agg(F.min("y").alias("root")).select(F.col("x").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
