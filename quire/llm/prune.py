"""A bitmap of fixed size that keeps most rows of a large table away from a join with few keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 64-bit words of a bitmap: 2**18 rows of two numbers at most are broadcast, whatever the size of the input.
WORDS = 1 << 18


def _place(key: Column) -> tuple[Column, Column]:
    h = F.xxhash64(key)
    return F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(WORDS - 1)), F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))


def parted(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: str) -> tuple[DataFrame, DataFrame]:
    """rows as (likely, rest): no row of rest has a key in wanted; likely also holds some rows whose key is not there.

    The more keys are wanted, the more rows are likely; the result of a join with `likely` is always that with all rows.
    Both parts keep the order of columns; rows with a null key are in rest.
    """
    word, bit = _place(F.col(wanted_key).cast("long"))
    bits = wanted.where(F.col(wanted_key).isNotNull()).select(word.alias("__word"), bit.alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    word, bit = _place(key.cast("long"))
    marked = rows.withColumns({"__key_word": word, "__key_bit": bit}).join(F.broadcast(bits), F.col("__key_word") == F.col("__word"), "left")
    hit = F.coalesce(F.col("__bits").bitwiseAND(F.col("__key_bit")) != 0, F.lit(False)) & key.isNotNull()
    out = marked.withColumn("__hit", hit)
    extra = ["__key_word", "__key_bit", "__word", "__bits", "__hit"]
    return out.where("__hit").drop(*extra), out.where("NOT __hit").drop(*extra)
