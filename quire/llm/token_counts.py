"""Token counts by rank-synchronous array merging (operator 6)."""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from quire.llm.batches import records, sliced
from quire.llm.bytebpe import counter


def token_counts(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", limit: int = 1024) -> DataFrame:
    """One row per input row: key, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have 0 bytes and 0 tokens; repeated and null keys stay as they are; other columns are not read.
    Each text is read whole, in slices of bounded size. No shuffle: a lost task is computed again from its input split.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = pa.schema([("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches):
        own = counter(tokenizer)
        for part, texts in sliced(batches, "t"):
            counts = own.count(texts)
            sizes = pc.fill_null(pc.binary_length(part.column("t")), 0).cast(pa.int64())
            out = records(schema, [sizes, counts, [n > limit for n in counts]])
            yield pa.RecordBatch.from_arrays([part.column("k"), *out.columns], names=[key, *schema.names])

    return docs.selectExpr(f"`{key}` AS k", f"`{text}` AS t").mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
