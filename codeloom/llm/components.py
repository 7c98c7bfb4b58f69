"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import stage


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node) of every node of ``edges(a, b)``.

    Each round is one aggregate and one join per star, so a node with very many
    neighbours is never one task's list. Both steps of the small star and what
    makes links distinct share one exchange. Rounds are staged as tables. The last
    one leaves every node one link, to a node without any.
    """
    named = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = stage(named, "links")
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = (
            both.join(least, "a")
            .filter("b > a and b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        # Every node keeps its link to the least neighbour it has now.
        large = large.unionByName(least.filter("m < a").select("a", F.col("m").alias("b")))
        large = large.repartition("a").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        more = large.join(lower, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = lower.select("a", F.col("m").alias("b"), F.lit(False).alias("more"))
        links = stage(small.unionByName(more.withColumn("more", F.lit(True))), "links")
        if not links.filter("more").isEmpty():  # repeated links go in the next round
            links = links.drop("more")
            continue
        links = links.drop("more")
        ends = links.select(F.col("a").alias("node"), F.lit(1).alias("low"), F.lit(0).alias("high"))
        ends = ends.unionByName(links.select(F.col("b").alias("node"), F.lit(0).alias("low"), F.lit(1).alias("high")))
        chained = ends.groupBy("node").agg(F.max("low").alias("low"), F.max("high").alias("high"))
        if not chained.agg(F.coalesce(F.max(F.col("low") * F.col("high")), F.lit(0))).first()[0]:
            break
    roots = links.select(F.col("b").alias("node")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
