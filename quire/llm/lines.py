"""Line dedup by a suffix array over line-id sequences (operator 9).

Each document is its sequence of line ids. Distributed prefix doubling ranks the runs of 1, 2, 4, ... lines that start at
every position by the pair of ranks of their halves; a position whose run occurs once drops out, so each round handles only
what still repeats. The groups of equal ranks of a round are the suffix array's intervals of at least that common prefix: how
many places share it, and which is the first. Positions that follow each other in a document, and whose first places follow
each other too, share one longer prefix: they are joined to maximal repeated runs, and what these runs cover is deleted.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.batches import sliced
from quire.llm.prune import parted
from quire.llm.ranks import ranked_pairs
from quire.llm.words import strong
from quire.session import discard, materialise, small_batches

WHITE = " \t\n\v\f\r"


def line_ids(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each text, the 128-bit ids (upper and lower half) of its lines that have a word, and their numbers of words."""
    out = []
    for text in texts:
        lines = text.encode().split(b"\n")
        words = [len(line.split()) for line in lines]
        ids = np.array([strong(line) for line, n in zip(lines, words, strict=True) if n], np.uint64).reshape(-1, 2).view(np.int64)
        out.append((ids[:, 0], ids[:, 1], np.array([n for n in words if n], np.int32)))
    return out


def sequences(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(doc, th, a, b, words) per distinct document row: lists of ids and of numbers of words; th is a hash of the text."""

    def run(batches):
        for part, texts in sliced(batches, "t"):
            a, b, words = zip(*line_ids(texts), strict=True)
            lists = [pa.array(a, pa.list_(pa.int64())), pa.array(b, pa.list_(pa.int64())), pa.array(words, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([part.column("k"), part.column("th"), *lists], names=["doc", "th", "a", "b", "words"])

    rows = docs.where(f"`{key}` IS NOT NULL AND `{text}` IS NOT NULL").selectExpr(f"CAST(`{key}` AS long) AS k", f"xxhash64(`{text}`) AS th", f"`{text}` AS t")
    return rows.mapInArrow(run, "doc long, th long, a array<long>, b array<long>, words array<int>").dropDuplicates(["doc", "th"])


def repeated_runs(docs: DataFrame, text: str = "text", key: str = "doc_id") -> list[DataFrame]:
    """One table per depth k: the positions whose run of 2**k lines occurs more than once, as (doc, th, i, own, words, rank,
    many, first). own and words count the words of the position's line and of the run, many the places of the run, first
    is the smallest of them. Rounds end when no run repeats any more."""
    small_batches(docs.sparkSession)
    lines = sequences(docs, text, key).select("doc", "th", F.posexplode(F.arrays_zip("a", "b", "words")).alias("i", "e"))
    lines = materialise(lines.select("doc", "th", "i", F.col("e.words").alias("own"), F.col("e.words").alias("words"), F.col("e.a").alias("a"), F.col("e.b").alias("b")), "lines")
    levels = [ranked_pairs(lines)]
    discard(docs.sparkSession, lines)
    while not levels[-1].isEmpty():
        here, step = levels[-1], 1 << (len(levels) - 1)
        there = here.select("doc", "th", (F.col("i") - step).alias("i"), F.col("rank").alias("b"), F.col("words").alias("w"))
        pairs = here.select("doc", "th", "i", "own", "words", F.col("rank").alias("a")).join(there, ["doc", "th", "i"])
        pairs = materialise(pairs.select("doc", "th", "i", "own", (F.col("words") + F.col("w")).alias("words"), "a", "b"), "pairs")
        levels.append(ranked_pairs(pairs))
        discard(docs.sparkSession, pairs)
    discard(docs.sparkSession, levels.pop())
    return levels


def maximal_runs(levels: list[DataFrame]) -> DataFrame:
    """(doc, th, k, i, last, words): the later copies of repeated runs, as lines i to last of a document.

    For each depth k, positions that are not their run's first place are chained while position and first place both move on
    by one; a chain from i to j covers the lines i to j + 2**k - 1, which stand as a whole at the first place too.
    """
    rows = None
    for k, level in enumerate(levels):
        later = level.where("struct(doc, th, i) > first").select("doc", "th", F.lit(k).alias("k"), "i", "own", "words", "first")
        rows = later if rows is None else rows.unionAll(later)
    where = "OVER (PARTITION BY doc, th, k ORDER BY i)"
    held = f"i - lag(i) {where} = 1 AND first.doc = lag(first.doc) {where} AND first.th = lag(first.th) {where} AND first.i - lag(first.i) {where} = 1"
    marked = rows.withColumn("chain", F.expr(f"CASE WHEN {held} THEN 0 ELSE 1 END")).withColumn("chain", F.expr(f"sum(chain) {where}"))
    chains = marked.groupBy("doc", "th", "k", "chain").agg(F.min("i").alias("i"), F.max("i").alias("j"), F.sum("own").alias("own"), F.max(F.struct("i", "own", "words")).alias("end"))
    return chains.select("doc", "th", "k", "i", F.expr("CAST(j + shiftleft(1, k) - 1 AS int)").alias("last"), F.expr("own - end.own + end.words").alias("words"))


def later_lines(docs: DataFrame, min_words: int = 10, min_places: int = 20, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc, th, gone, longest): the line numbers (among lines with a word) that later copies of repeated runs cover.

    A maximal run counts from min_words words on, and a single line of any length if it stands in min_places places. longest
    is the number of lines of the longest later copy, whether it counts or not.
    """
    spark = docs.sparkSession
    levels = repeated_runs(docs, text, key)
    if not levels:
        return spark.createDataFrame([], "doc long, th long, gone array<int>, longest int")
    frequent = levels[0].where(F.col("many") >= min_places).where("struct(doc, th, i) > first")
    runs = maximal_runs(levels).select("doc", "th", "i", "last", (F.col("words") >= min_words).alias("counts"))
    runs = runs.unionAll(frequent.select("doc", "th", "i", F.col("i").alias("last"), F.lit(True)))
    marks = F.when(F.col("counts"), F.sequence("i", "last")).otherwise(F.array().cast("array<int>"))
    out = runs.groupBy("doc", "th").agg(F.array_distinct(F.flatten(F.collect_list(marks))).alias("gone"), F.max(F.col("last") - F.col("i") + 1).alias("longest"))
    out = materialise(out, "gone")
    for level in levels:
        discard(spark, level)
    return out


def kept_lines(text: str, gone: list[int] | None) -> tuple[list[str], int]:
    """The lines that stay (those without a word always do), and the number of lines with a word."""
    lost, out, n = set(gone or ()), [], 0
    for line in text.split("\n"):
        if line.strip(WHITE):
            if n not in lost:
                out.append(line)
            n += 1
        else:
            out.append(line)
    return out, n


def line_report(docs: DataFrame, text: str = "text", key: str = "doc_id", **rules: int) -> DataFrame:
    """One row per input row: doc_id, n_lines (with a word), n_removed, kept_sha256 (kept lines joined by newlines), and
    longest_copy, the lines of the longest run that stands earlier too.

    A line of a run is removed if the same run starts earlier (smaller id, or before it in the same text) and it counts
    (later_lines). Null and empty texts have no lines; rows with a null id lose nothing and remove nothing; equal repeated
    rows count as one document, different texts of one id as documents in the order of a hash of theirs.
    """

    def run(batches):
        for part, texts in sliced(batches, "t"):
            rows = []
            for t, gone in zip(texts, part.column("gone").to_pylist(), strict=True):
                kept, n = kept_lines(t, gone)
                rows.append((n, len(gone or ()), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([part.column("k"), *(pa.array(c) for c in columns), part.column("longest")], names=["doc_id", "n_lines", "n_removed", "kept_sha256", "longest_copy"])

    gone = later_lines(docs, text=text, key=key, **rules)
    rows = docs.selectExpr(f"CAST(`{key}` AS long) AS k", f"`{text}` AS t").withColumn("th", F.xxhash64("t"))
    likely, rest = parted(rows, F.col("k"), gone, "doc")
    joined = likely.join(gone.withColumnRenamed("doc", "k"), ["k", "th"], "left").select("k", "t", "gone", F.coalesce("longest", F.lit(0)).alias("longest"))
    rest = rest.select("k", "t", F.lit(None).cast("array<int>").alias("gone"), F.lit(0).alias("longest"))
    return joined.unionAll(rest).mapInArrow(run, "doc_id long, n_lines long, n_removed long, kept_sha256 string, longest_copy int")


def drop_later_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", **rules: int) -> DataFrame:
    """docs with all their columns and without later copies of repeated runs; documents that lose every line go."""
    names = docs.columns

    def run(batches):
        at = names.index(text)
        for part, texts in sliced(batches, text):
            out, keep = [], []
            for t, null, gone in zip(texts, part.column(at).is_null().to_pylist(), part.column(len(names)).to_pylist(), strict=True):
                kept, n = kept_lines(t, gone) if gone else ([], 0)
                out.append("\n".join(kept) if gone else None if null else t)
                keep.append(not gone or len(gone) < n)
            columns = [pa.array(out, part.column(at).type) if i == at else part.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))

    gone = later_lines(docs, text=text, key=key, **rules).select(F.col("doc").alias("__doc"), F.col("th").alias("__th"), F.col("gone").alias("__gone"))
    likely, rest = parted(docs, docs[key], gone, "__doc")
    joined = likely.join(gone, (likely[key].cast("long") == gone["__doc"]) & (F.xxhash64(likely[text]) == gone["__th"]), "left")
    return joined.select(*[likely[c] for c in names], "__gone").mapInArrow(run, docs.schema).unionAll(rest)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
