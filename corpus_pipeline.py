"""A corpus pipeline of five operators; each stage reads what its predecessor kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet
to the shared folder and reads again as the next stage's docs; scratch tables go after each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.jaccard import jaccard_classes
from quire.llm.lines import drop_later_lines
from quire.llm.packing import pack
from quire.llm.prune import parted
from quire.llm.quality import keep_good, train
from quire.llm.substrings import remove_repeats
from quire.session import cleared, discard, materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the line labels reject go. The field is trained on labelled documents of docs."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep_good(docs, train(docs, labels))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of lines go, of however few words; so do documents of which no line is left."""
    return drop_later_lines(docs, min_words=1)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that five-word shingles with a similarity of 0.8 link, the smallest doc_id stays; rows with a null
    doc_id stay too."""
    classes = jaccard_classes(docs, words=5, num=80, den=100)
    later = materialise(classes.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct(), "later")
    likely, rest = parted(docs, docs["doc_id"], later, "__gone")
    return likely.join(later, likely["doc_id"] == later["__gone"], "left_anti").unionAll(rest)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of 50 that a smaller doc_id holds too go; every document stays, an emptied one with an empty text."""
    return remove_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens, as pieces of documents."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

#: Tokens, trained labels and suffix ranks can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage has left in the shared folder goes once its result is written, and so does the
    result of the stage before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        before = docs
        with cleared(spark) as scratch:
            docs = materialise(stage(spark, before, sf_dir), name)
            scratch.pop()
        if number:
            discard(spark, before)
    return docs
