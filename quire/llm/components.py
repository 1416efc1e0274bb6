"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import discard, materialise


def components(links: DataFrame) -> DataFrame:
    """links (a long, b long) to (node, component): the smallest node that can be reached; nodes without links are absent.

    Large-star and small-star rounds alternate until nothing changes; each round is an aggregation and an equi-join over
    the links, written to the shared folder. Only the number of links and a checksum reach the driver.
    """
    spark = links.sparkSession
    edges = materialise(links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct(), "links")
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").selectExpr("v AS u", "m AS v").where("u <> v").distinct()
        large = materialise(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").selectExpr("v AS u", "m AS v").unionAll(least.selectExpr("u", "m AS v")).where("u <> v").distinct()
        small = materialise(small, "small")
        now = small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(spark, large)
        discard(spark, edges)
        edges = small
        if tuple(now) == before:
            break
        before = tuple(now)
    return edges.groupBy("u").agg(F.min("v").alias("component")).selectExpr("u AS node", "component").unionAll(edges.selectExpr("v AS node", "v AS component").distinct())
