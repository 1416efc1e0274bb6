"""Substring dedup over a log-structured fingerprint index (operator 4).

Every shared window of 50 words holds a fingerprint that both documents select: the least hash of its 20-word grams, chosen
in each window by its content alone. Batches of documents in ascending id order are written as immutable runs sorted by
fingerprint and merge-joined with the older runs, which are compacted level by level. Only around fingerprints that occur in
several documents are whole windows compared, by 96 bits of hash, with the smallest document that holds them.
"""

from __future__ import annotations

import hashlib
import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.batches import sliced
from quire.llm.prune import parted
from quire.llm.words import windows_of, words_of
from quire.session import discard, listed, materialise, scratch_path, small_batches, write_text

GRAM = 20
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def selected(grams: np.ndarray, width: int) -> np.ndarray:
    """Positions of the leftmost least value of every `width` neighbouring grams."""
    if len(grams) < width:
        return np.empty(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, width)
    out = [np.unique(view[i : i + 8192].argmin(1) + np.arange(i, min(i + 8192, len(view)))) for i in range(0, len(view), 8192)]
    return np.unique(np.concatenate(out))


def fingerprints(docs: DataFrame, window: int, text: str, key: str) -> DataFrame:
    """doc, n_words, sha256 of the words joined by one space, and the selected fingerprints with their word positions."""
    gram = min(GRAM, max(1, window // 2))

    def run(batches):
        for part, texts in sliced(batches, "t"):
            words = words_of(texts)
            grams = windows_of(words.hash, gram).astype(np.int64)
            at, hashes, sha = [], [], []
            for t, a, b in zip(texts, words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
                own = selected(grams[a : b - gram + 1], window - gram + 1) if b - a >= window else np.empty(0, np.int64)
                at.append(own)
                hashes.append(grams[a + own])
                sha.append(hashlib.sha256(b" ".join(t.encode().split())).hexdigest())
            ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in at])]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.column("k"), pa.array(words.counts(), pa.int64()), pa.array(sha, pa.string()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(hashes), pa.int64())), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(at), pa.int32()))],
                names=["doc", "n_words", "sha", "h", "pos"],
            )

    return docs.selectExpr(f"CAST(`{key}` AS long) AS k", f"`{text}` AS t").mapInArrow(run, "doc long, n_words long, sha string, h array<long>, pos array<int>")


class FingerprintIndex:
    """Immutable runs (h, doc, pos), bucketed and sorted by h, in levels of growing size, in a folder that all workers see.

    Runs of one bucket count join without a shuffle: each bucket is one sorted file, so a probe is a merge of sorted runs.
    When a level holds more than `fan` runs they are merged into one run of the next level and dropped. After every batch a
    manifest with a higher number names the runs, so the folder can be opened again, by another session too, and a batch
    that failed half way leaves nothing that counts.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int, fan: int = 2):
        self.spark, self.path, self.buckets, self.fan = spark, path, buckets, fan
        self.levels: list[list[str]] = []
        self.state: dict = {}
        self.version = 0
        self.tables: list[str] = []
        if found := [f for f in listed(spark, path) if f.startswith("manifest-")]:
            last = max(found)
            saved = json.loads(spark.read.text(f"{path}/{last}", wholetext=True).first()[0])
            self.levels, self.buckets, self.state = saved["levels"], saved["buckets"], saved["state"]
            self.version = int(last[9:-5])
            for name in [name for level in self.levels for name in level]:
                spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (h BIGINT, doc BIGINT, pos INT) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {self.buckets} BUCKETS LOCATION '{path}/{name}'")
                self.tables.append(name)

    def write(self, rows: DataFrame) -> str:
        name = f"quire_run_{uuid.uuid4().hex}"
        self.tables.append(name)
        rows.repartition(self.buckets, "h").write.bucketBy(self.buckets, "h").sortBy("h").option("path", f"{self.path}/{name}").saveAsTable(name)
        return name

    def add(self, entries: DataFrame) -> list[DataFrame]:
        """Write a batch as a run; return its fingerprints (h) that older runs hold or that several of its documents hold."""
        run = self.write(entries)
        own = self.spark.table(run)
        hits = [own.select("h").join(self.spark.table(old).select("h"), "h", "left_semi") for level in self.levels for old in level]
        hits.append(own.groupBy("h").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("h"))
        out = [materialise(hit.distinct(), "hits") for hit in hits]
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(run)
        self.compact()
        return out

    def save(self, **state) -> None:
        """Make what was added since the last call count."""
        self.state |= state
        self.version += 1
        write_text(self.spark, f"{self.path}/manifest-{self.version:09d}.json", json.dumps({"levels": self.levels, "buckets": self.buckets, "state": self.state}))
        for name in [name for name in self.tables if not any(name in level for level in self.levels)]:
            self.drop(name)

    def compact(self) -> None:
        for k, level in enumerate(self.levels):
            if len(level) > self.fan:
                merged = self.spark.table(level[0])
                for name in level[1:]:
                    merged = merged.unionAll(self.spark.table(name))
                run = self.write(merged)
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k] = []
                self.levels[k + 1].append(run)

    def entries(self) -> DataFrame:
        runs = [self.spark.table(name) for level in self.levels for name in level]
        out = runs[0]
        for run in runs[1:]:
            out = out.unionAll(run)
        return out

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        discard(self.spark, f"{self.path}/{name}")
        self.tables.remove(name)

    def close(self) -> None:
        """Forget the tables; the folder stays."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables = []


def flagged(index: FingerprintIndex, hits: list[DataFrame]) -> DataFrame:
    """(doc, marks): the positions of fingerprints that several documents hold."""
    shared = hits[0]
    for hit in hits[1:]:
        shared = shared.unionAll(hit)
    return index.entries().join(shared.distinct(), "h", "left_semi").groupBy("doc").agg(F.collect_list("pos").alias("marks"))


def window_digests(suspects: DataFrame, window: int) -> DataFrame:
    """(h, g, doc, pos): BLAKE2b of the words, joined by one space, of every window around a mark of (doc, t, marks)."""
    gram = min(GRAM, max(1, window // 2))

    def emit(batches):
        for part, texts in sliced(batches, "t"):
            keys, own, at = [], [], []
            for k, (t, marks) in enumerate(zip(texts, part.column("marks").to_pylist(), strict=True)):
                words = t.encode().split()
                n = len(words) - window + 1
                if n <= 0:
                    continue
                step = np.zeros(n + 1, np.int32)
                mark = np.asarray(marks, np.int64)
                np.add.at(step, np.clip(mark - (window - gram), 0, n), 1)
                np.add.at(step, np.clip(mark + 1, 0, n), -1)
                pos = np.flatnonzero(np.cumsum(step[:-1]) > 0)
                raw = b" ".join(words)
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
                starts = np.concatenate([[0], ends[:-1] + 1])
                keys += [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(starts[pos].tolist(), ends[pos + window - 1].tolist(), strict=True)]
                own.append(np.full(len(pos), k))
                at.append(pos)
            if keys:
                halves = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
                doc = np.asarray(part.column("doc"))[np.concatenate(own)]
                yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array(doc), pa.array(np.concatenate(at).astype(np.int32))], names=["h", "g", "doc", "pos"])

    return suspects.mapInArrow(emit, "h long, g long, doc long, pos int")


def first_copies(windows: DataFrame) -> DataFrame:
    """(h, g, first) of the windows (h, g, doc, pos) that several documents hold. First documents are aggregated before the
    shuffle, so a window in a large share of all documents costs a row per task."""
    return windows.groupBy("h", "g").agg(F.min("doc").alias("first"), F.max("doc").alias("top")).where("first < top").drop("top")


def later_copies(windows: DataFrame, first: DataFrame) -> DataFrame:
    """(doc, starts) of the windows that a smaller document holds too. `first` is a written table, so the join stands alone and
    Spark can split a frequent window over tasks."""
    return windows.join(first, ["h", "g"]).where("doc > first").groupBy("doc").agg(F.collect_set("pos").alias("starts"))


def covered(n: int, starts: list[int], window: int) -> np.ndarray:
    """Which of n words a window at one of the starts covers."""
    step = np.zeros(n + 1, np.int32)
    at = np.asarray(starts, np.int64)
    at = at[at + window <= n]
    np.add.at(step, at, 1)
    np.add.at(step, at + window, -1)
    return np.cumsum(step[:-1]) > 0


def whole_copies(prints: DataFrame) -> DataFrame:
    """doc, n_words, sha, copy (an equal word sequence stands in a smaller document), per row."""
    first = prints.where("doc IS NOT NULL AND n_words > 0").groupBy("sha").agg(F.min("doc").alias("first"))
    return prints.select("doc", "n_words", "sha").join(first, "sha", "left").selectExpr("doc", "n_words", "sha", "coalesce(doc > first, false) AS copy")


def leading(prints: DataFrame, base: DataFrame, window: int) -> DataFrame:
    """The fingerprints of the first document of each word sequence."""
    return prints.join(base.where(f"NOT copy AND n_words >= {window} AND doc IS NOT NULL").select("doc", "sha").distinct(), ["doc", "sha"], "left_semi")


def exploded(leaders: DataFrame) -> DataFrame:
    return leaders.select("doc", F.explode(F.arrays_zip("h", "pos")).alias("e")).select("e.h", "doc", "e.pos")


def cuts_of(texts: DataFrame, marks: DataFrame, window: int, above: int | None = None) -> DataFrame:
    """(doc, t, starts) of the documents (doc, t) that lose windows, of those above an id if one is given."""
    spark = texts.sparkSession
    marks = materialise(marks, "flagged")
    likely, _ = parted(texts, F.col("doc"), marks, "doc")
    suspects = materialise(likely.join(marks, "doc"), "suspects", compression="zstd")
    windows = materialise(window_digests(suspects, window), "windows")
    first = materialise(first_copies(windows), "first")
    removed = later_copies(windows, first)
    if above is not None:
        removed = removed.where(F.col("doc") > above)
    cuts = materialise(suspects.select("doc", "t").join(removed, "doc"), "cuts", compression="zstd")
    for table in (marks, suspects, windows, first):
        discard(spark, table)
    return cuts


def analyse(docs: DataFrame, window: int = 50, batches: int = 3, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Returns two tables.

    base: doc, n_words, sha, copy (an equal word sequence stands in a smaller document), per input row.
    cuts: doc, t (its text), starts (first words of the windows to remove), for the other documents that lose words.
    """
    spark = docs.sparkSession
    small_batches(spark)
    prints = materialise(fingerprints(docs, window, text, key), "prints")
    base = materialise(whole_copies(prints), "base")
    leaders = leading(prints, base, window)
    spread = prints.where("doc IS NOT NULL").agg(F.percentile_approx("doc", [k / batches for k in range(1, batches)], 1000)).first()[0] or []
    bounds = [None, *sorted(set(spread)), None]
    path = scratch_path(spark, "index")
    index = FingerprintIndex(spark, path, int(spark.conf.get("spark.sql.shuffle.partitions")))
    hits: list[DataFrame] = []
    try:
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            part = leaders
            if lo is not None:
                part = part.where(F.col("doc") > lo)
            if hi is not None:
                part = part.where(F.col("doc") <= hi)
            hits += index.add(exploded(part))
            index.save()
        cuts = cuts_of(docs.selectExpr(f"CAST(`{key}` AS long) AS doc", f"`{text}` AS t"), flagged(index, hits), window)
    finally:
        index.close()
        for table in (path, prints, *hits):
            discard(spark, table)
    return base, cuts


class SubstringIndex:
    """Incremental dedup: batches of documents with ascending ids, each held against everything that was added before.

    The folder holds the runs of fingerprints and, for verification, the texts of their documents. It can be opened again.
    """

    def __init__(self, spark: SparkSession, path: str, window: int = 50, buckets: int | None = None):
        self.spark, self.path = spark, path
        self.runs = FingerprintIndex(spark, f"{path}/runs", buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.window = self.runs.state.get("window", window)

    def add(self, docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
        """The rows of removals() for a batch, judged against the batch and all earlier ones. Its ids must be larger than
        those of earlier batches (ValueError otherwise); a batch that fails leaves the index as it was."""
        spark, state = self.spark, self.runs.state
        small_batches(spark)
        least, most = docs.agg(F.min(F.col(key).cast("long")), F.max(F.col(key).cast("long"))).first()
        top = state.get("top")
        if top is not None and least is not None and least <= top:
            raise ValueError(f"ids of a batch must be above {top}")
        prints = materialise(fingerprints(docs, self.window, text, key), "prints")
        base = materialise(whole_copies(prints), "base")
        own = f"{self.path}/texts-{uuid.uuid4().hex}"
        before = [list(level) for level in self.runs.levels]
        hits: list[DataFrame] = []
        try:
            leaders = leading(prints, base, self.window)
            rows = docs.selectExpr(f"CAST(`{key}` AS long) AS doc", f"`{text}` AS t").where("doc IS NOT NULL AND t IS NOT NULL")
            rows.join(leaders.select("doc").distinct(), "doc", "left_semi").write.option("compression", "zstd").parquet(own)
            texts = [*state.get("texts", []), own]
            hits = self.runs.add(exploded(leaders))
            cuts = cuts_of(spark.read.schema("doc long, t string").parquet(*texts), flagged(self.runs, hits), self.window, top)
            out = materialise(removal_rows(base, cuts, self.window), "removals")
            self.runs.save(window=self.window, top=top if most is None else most, texts=texts)
        except BaseException:
            self.runs.levels = before
            discard(spark, own)
            raise
        finally:
            for table in (prints, base, *hits):
                discard(spark, table)
        return out

    def close(self) -> None:
        self.runs.close()


def removals(docs: DataFrame, window: int = 50, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space).

    A word goes if a window of `window` consecutive words covers it whose word sequence also starts in a document with a
    smaller id; windows are judged on the input. Null and empty texts have no words; rows with a null id lose nothing and
    remove nothing. doc_id names a document: equal repeated rows get equal results, and where different texts share an id,
    a position that one of them loses is lost in all of them.
    """
    return removal_rows(*analyse(docs, window, text=text, key=key), window)


def removal_rows(base: DataFrame, cuts: DataFrame, window: int) -> DataFrame:
    def rest(batches):
        for part, texts in sliced(batches, "t"):
            out = []
            for t, starts in zip(texts, part.column("starts").to_pylist(), strict=True):
                words = t.encode().split()
                gone = covered(len(words), starts, window)
                kept = [w for w, x in zip(words, gone.tolist(), strict=True) if not x]
                out.append((hashlib.sha256(b" ".join(words)).hexdigest(), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield pa.RecordBatch.from_arrays([part.column("doc"), *(pa.array(c) for c in zip(*out, strict=True))], names=["doc", "sha", "gone", "kept"])

    some = cuts.mapInArrow(rest, "doc long, sha string, gone long, kept string").dropDuplicates(["doc", "sha"])
    whole = F.col("copy") & (F.col("n_words") >= window)
    return base.join(some, ["doc", "sha"], "left").select(
        F.col("doc").alias("doc_id"),
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(EMPTY_SHA256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )


def cut_text(text: str, starts: list[int], window: int) -> str:
    """The text without the words that the windows cover; each removed run goes with the white space behind it."""
    words = words_of([text])
    gone = covered(len(words.begin), starts, window)
    raw = text.encode()
    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    out, at = [], 0
    for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        out.append(raw[at : words.begin[i]])
        at = int(words.begin[j]) if j < len(words.begin) else len(raw)
    return b"".join([*out, raw[at:]]).decode()


def remove_repeats(docs: DataFrame, window: int = 50, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs, all rows and columns, without the words that removals() counts; what is left keeps its line breaks."""
    base, cuts = analyse(docs, window, text=text, key=key)

    def rest(batches):
        for part, texts in sliced(batches, "t"):
            out = [cut_text(t, s, window) for t, s in zip(texts, part.column("starts").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("t"), pa.array(out, pa.string())], names=["__doc", "__text", "__kept"])

    some = cuts.mapInArrow(rest, "__doc long, __text string, __kept string").select("__doc", F.xxhash64("__text").alias("__of"), "__kept").dropDuplicates(["__doc", "__of"])
    copies = base.where(f"copy AND n_words >= {window}").select(F.col("doc").alias("__doc"), F.lit(True).alias("__copy")).distinct()
    touched = materialise(some.select("__doc").unionAll(copies.select("__doc")).distinct(), "touched")
    likely, rest_ = parted(docs, docs[key], touched, "__doc")
    found = likely.join(some, (likely[key] == some["__doc"]) & (F.xxhash64(likely[text]) == some["__of"]), "left").drop("__doc", "__of")
    found = found.join(copies, found[key] == copies["__doc"], "left")
    kept = F.when(F.col("__copy"), F.lit("")).otherwise(F.coalesce("__kept", likely[text]))
    return found.select(*[kept.alias(c) if c == text else likely[c] for c in docs.columns]).unionAll(rest_)


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(spark.read.parquet(f"{sf_dir}/documents.parquet"))
