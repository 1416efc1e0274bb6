"""Token-ID output: Parquet list columns with dictionary and delta encoding, small row groups and page indexes (operator 7)."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.batches import sliced
from quire.llm.bytebpe import encoder
from quire.session import scratch_path, small_batches

#: Ids have at most some 50 thousand values: dictionary pages hold them in two bytes each. Sorted and small integers are
#: delta encoded, which format version 2 does where the dictionary is off. Pages carry at most 2000 rows, so the page
#: index (written by default) can skip most of a row group when a reader asks for a range of documents.
FORMAT = {
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#local_start": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}
SCHEMA = "part int, doc_id {kind}, local_start long, n_tokens long, ids array<int>"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None, text: str = "text", key: str = "doc_id") -> None:
    """Encode whole texts (null: empty), append end_id, and write rows in ascending key order (null keys first).

    Files follow each other by name as the keys do; within a file rows are sorted. local_start counts the ids before a
    document in its file. Repeated keys are written as often as they come. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    end = [end_id] if end_id is not None else []

    def run(batches):
        own, before = encoder(tokenizer), 0
        tail = np.asarray(end, "<u4").tobytes()
        for part, texts in sliced(batches, "t"):
            raw = [x + tail for x in own.encode(texts)]
            n = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
            ends = np.cumsum(n)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(np.frombuffer(b"".join(raw), "<i4"), pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column("p"), part.column("k"), pa.array(before + ends - n), pa.array(n), ids], names=["part", "doc_id", "local_start", "n_tokens", "ids"])
            before += int(ends[-1])

    rows = docs.selectExpr(f"`{key}` AS k", f"`{text}` AS t").repartitionByRange("k").sortWithinPartitions("k").withColumn("p", F.spark_partition_id())
    rows.mapInArrow(run, SCHEMA.format(kind=kind)).write.options(**FORMAT).parquet(path)


def read_tokens(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Columns of the table written by write_tokens, with `part` and `local_start`; ids stay on disk unless asked for."""
    return spark.read.parquet(path).select("part", "local_start", *columns)


def read_range(spark: SparkSession, path: str, low: int, high: int, columns: list[str]) -> DataFrame:
    """Like read_tokens, for documents with low <= doc_id <= high only.

    The range reaches the reader: files and row groups outside it are passed over by their statistics, and within a row
    group the page index leaves only the pages that can hold such documents to be decoded, of ids as of all other columns.
    """
    return read_tokens(spark, path, [*dict.fromkeys(["doc_id", *columns])]).where(F.col("doc_id").between(low, high))


def with_starts(rows: DataFrame, path: str) -> DataFrame:
    """Add `start`, the number of ids of all documents before each one, to rows that have part and local_start.

    The bases of the files come from the sums of their n_tokens, one row per file. Join before the ids are read or after
    they are condensed: the join shuffles its rows.
    """
    totals = rows.sparkSession.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("total"))
    bases = totals.selectExpr("part", "sum(total) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - total AS base")
    return rows.join(bases, "part").withColumn("start", F.col("base") + F.col("local_start")).drop("base", "part", "local_start")


def id_digests(rows: DataFrame) -> DataFrame:
    """part, local_start, doc_id, n_tokens and the crc32 of the ids as little-endian unsigned 32-bit integers."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["part", "local_start", "doc_id", "n_tokens"]

    def run(batches):
        for batch in batches:
            ids = batch.column("ids")
            at = np.asarray(ids.offsets)
            raw = memoryview(np.ascontiguousarray(np.asarray(ids.values).astype("<u4", copy=False)).view(np.uint8))
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(crc, pa.int64())], names=[*names, "ids_crc32"])

    return rows.select(*names, "ids").mapInArrow(run, f"part int, local_start long, doc_id {kind}, n_tokens long, ids_crc32 long")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    digests = id_digests(read_tokens(spark, path, ["doc_id", "n_tokens", "ids"]))
    return with_starts(digests, path).select("doc_id", "start", "n_tokens", "ids_crc32")
