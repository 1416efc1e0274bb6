"""Ranks of pairs, the step that distributed prefix doubling repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import discard, materialise


def ranked_pairs(pairs: DataFrame) -> DataFrame:
    """(doc, th, i, own, words, rank, many, first) of the rows (doc, th, i, own, words, a, b) whose pair (a, b) occurs more
    than once. Ranks grow with the pair; many counts its rows, first is the smallest (doc, th, i) of them.

    Counts and first places are aggregated before they are shuffled, so a pair that holds much of the table costs a row per
    task. Only the distinct repeated pairs are sorted over range partitions: a rank is a partition's number and the place in
    it. The rows get their rank by an equi-join, of which Spark can split a frequent pair over tasks.
    """
    spark = pairs.sparkSession
    groups = pairs.groupBy("a", "b").agg(F.count("*").alias("many"), F.min(F.struct("doc", "th", "i")).alias("first")).where("many > 1")
    groups = materialise(groups, "groups")
    order = groups.repartitionByRange("a", "b").sortWithinPartitions("a", "b").withColumn("rank", F.monotonically_increasing_id())
    out = materialise(pairs.join(order, ["a", "b"]).select("doc", "th", "i", "own", "words", "rank", "many", "first"), "ranks")
    discard(spark, groups)
    return out
