"""N-gram Jaccard join by T-occurrence search with DivideSkip (operator 2).

Documents meet through segment signatures: the hash space is cut into more segments than two linked sets can differ in
elements, so at least one segment is equal in both; each document emits keys of as many non-empty segments as its size asks
for. Within a block of equal keys every document is searched against the block's first one and linked documents are contracted.
Blocks whose other documents lie in several components are gathered by their first other document, and the documents of such a
unit are searched against each other across components. Sketches of two bytes an element come first; whole sets travel only
for pairs that the sketches leave open. All searches are T-occurrence searches over inverted lists; no pair is written that is no link.
"""

from __future__ import annotations

import heapq
import math
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.batches import sliced
from quire.llm.components import components
from quire.llm.prune import WORDS, parted
from quire.llm.words import mix, shingle_sets, strong
from quire.session import discard, materialise, small_batches

RATIO = 1.5
CHUNK = 128  # documents under one set of inverted lists when they are held against a hub
DEAL = 512  # documents of one hub that one task searches at most, about
ELEMENTS = 4_000_000  # sketch elements that one part of a unit holds at most, about


class Signatures:
    """Keys of segments for a threshold num/den: two sets that link share at least one key of a common scheme.

    Scheme i serves sets of lo[i] to hi[i] elements and larger ones up to hi[i] * den / num. Linked sets of sizes a and b
    differ in at most (a + b) * (den - num) / (den + num) elements, so a set of size a emits its first d + 1 non-empty
    segments, d being that bound for the largest partner; a set with fewer non-empty segments emits the empty ones too.
    """

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.lo, self.hi, self.m = [], [], []
        lo = 1
        self.grow(lo, 1 << 24)

    def differ(self, both: int) -> int:
        return both * (self.den - self.num) // (self.den + self.num)

    def grow(self, lo: int, limit: int) -> None:
        while lo <= limit:
            hi = max(lo, math.ceil(lo * RATIO) - 1)
            d = self.differ(hi + hi * self.den // self.num)
            self.lo.append(lo)
            self.hi.append(hi)
            self.m.append(1 if d == 0 else d + 3 + d // 16)
            lo = hi + 1

    def keys(self, own: np.ndarray) -> np.ndarray:
        n = len(own)
        if not n:
            return np.empty(0, np.uint64)
        if n > self.hi[-1]:
            self.grow(self.hi[-1] + 1, 2 * n)
        at = int(np.searchsorted(self.hi, n))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(own ^ np.uint64(0xD6E8FEB86659FD93)), out=total[1:])
        out = []
        for i in range(at, -1, -1):
            most = self.hi[i] * self.den // self.num
            if most < n:
                break
            m = self.m[i]
            d = self.differ(n + min(most, n * self.den // self.num))
            cut = np.searchsorted(own, (np.arange(1, m, dtype=np.float64) / m * 2.0**64).astype(np.uint64))
            cut = np.concatenate([[0], cut, [n]])
            digest = mix((total[cut[1:]] - total[cut[:-1]]) + np.uint64(i << 40) + np.arange(m, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
            full = np.flatnonzero(cut[1:] > cut[:-1])
            out.append(digest[full[: d + 1]] if len(full) > d else digest)
        return np.concatenate(out)


class InvertedLists:
    """Inverted lists over some records, searched by DivideSkip."""

    def __init__(self, records: list[np.ndarray]):
        flat = np.concatenate(records)
        owner = np.repeat(np.arange(len(records)), [len(r) for r in records])
        order = np.argsort(flat, kind="stable")
        self.values, self.first = np.unique(flat[order], return_index=True)
        self.owner = owner[order]
        self.end = np.append(self.first[1:], len(flat))
        self.sizes = np.array([len(r) for r in records])

    def search(self, query: np.ndarray, need: np.ndarray, mu: float = 0.0085) -> list[tuple[int, int]]:
        """Records that share at least need[r] elements with the query, with the number shared.

        The longest lists are set aside: short ones are merged by a heap, records that occur often enough there are then
        looked up in the long lists by binary search.
        """
        at = np.searchsorted(self.values, query)
        at[at == len(self.values)] = 0
        at = at[self.values[at] == query]
        size = self.end[at] - self.first[at]
        at = at[np.argsort(size, kind="stable")]
        lists = [self.owner[a:b] for a, b in zip(self.first[at].tolist(), self.end[at].tolist(), strict=True)]
        least = int(need.min())
        if len(lists) < least:
            return []
        longest = len(lists[-1]) if lists else 1
        long = max(0, min(least - 1, int(least / (mu * math.log2(max(longest, 2)) + 1))))
        short, far = lists[: len(lists) - long], lists[len(lists) - long :]
        records, counts = merge_counts(short)
        keep = counts + long >= need[records]
        records, counts = records[keep], counts[keep]
        for k, own in enumerate(far):
            at = own.searchsorted(records)
            at[at == len(own)] = 0
            counts += own[at] == records
            if k % 16 == 15 and len(records):
                keep = counts + (len(far) - k - 1) >= need[records]
                records, counts = records[keep], counts[keep]
        keep = counts >= need[records]
        return list(zip(records[keep].tolist(), counts[keep].tolist(), strict=True))


def merge_counts(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Records of sorted lists and how many lists hold each: by a heap, or where the lists are long by a stable merge sort of
    their runs."""
    total = sum(map(len, lists))
    if total < 256:
        runs = [(record, sum(1 for _ in run)) for record, run in groupby(heapq.merge(*(x.tolist() for x in lists)))]
        return np.array([r for r, _ in runs], np.int64), np.array([c for _, c in runs], np.int64)
    flat = np.sort(np.concatenate(lists), kind="stable")
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    return flat[first], np.diff(np.append(first, len(flat)))


def overlap_needed(sizes: np.ndarray, query: int, num: int, den: int) -> np.ndarray:
    """Smallest intersection with which a set links to a query of the given size: 1 + num / den times it covers both sizes."""
    return np.maximum(1, -(-num * (sizes + query) // (num + den)))


def signed(docs: DataFrame, words: int, num: int, den: int, text: str, key: str) -> DataFrame:
    """doc, n (set size), twin and twin_2 (BLAKE2b of the whole set), keys; of equal sets in a task only the first has keys
    (so a large group of copies has one row per task), the others name it as `same`."""

    def run(batches):
        schemes = Signatures(num, den)
        seen: dict[tuple[int, int], int] = {}
        for part, texts in sliced(batches, "t"):
            docs_, n, twins, same, keys = part.column("k").to_pylist(), [], [], [], []
            for doc, own in zip(docs_, shingle_sets(texts, words), strict=True):
                n.append(len(own))
                twins.append(strong(own.tobytes()))
                first = seen.setdefault(twins[-1], doc) if len(own) and doc is not None else doc
                same.append(first)
                keys.append(schemes.keys(own).astype(np.int64) if first == doc and doc is not None else np.empty(0, np.int64))
                if len(seen) > 500_000:
                    seen.clear()
            flat = np.concatenate(keys)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in keys])])
            halves = np.array(twins, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("k"), pa.array(n, pa.int64()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array(same, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))],
                names=["doc", "n", "twin", "twin_2", "same", "keys"],
            )

    return docs.selectExpr(f"CAST(`{key}` AS long) AS k", f"`{text}` AS t").mapInArrow(run, "doc long, n long, twin long, twin_2 long, same long, keys array<long>")


def block_members(signatures: DataFrame) -> DataFrame:
    """(key, doc, hub) of every document in a block with at least two; hub is the block's smallest document.

    One shuffle by key and a sort; the scan holds one row back and no block.
    """

    def run(batches):
        last_key = last_doc = None
        hub, open_ = None, False
        for batch in batches:
            key, doc = np.asarray(batch.column("key")), np.asarray(batch.column("doc"))
            if not len(key):
                continue
            # blocks: runs of equal keys; the hub of a run is its first document, which may stem from the batch before
            new = np.empty(len(key), bool)
            new[0] = last_key is None or key[0] != last_key
            new[1:] = key[1:] != key[:-1]
            start = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            hubs = np.where(start >= 0, doc[np.maximum(start, 0)], 0 if hub is None else hub)
            follows = ~new
            keep = follows.copy()
            keep[:-1] |= new[:-1] & follows[1:]
            out_key, out_doc, out_hub = key[keep], doc[keep], hubs[keep]
            if follows[0] and open_:  # the first row of this block was held back
                out_key = np.concatenate([[last_key], out_key])
                out_doc = np.concatenate([[last_doc], out_doc])
                out_hub = np.concatenate([[hub], out_hub])
            open_ = bool(new[-1])
            last_key, last_doc, hub = key[-1], doc[-1], hubs[-1]
            yield pa.RecordBatch.from_arrays([pa.array(out_key, pa.int64()), pa.array(out_doc, pa.int64()), pa.array(out_hub, pa.int64())], names=["key", "doc", "hub"])

    rows = signatures.select(F.explode("keys").alias("key"), "doc").repartition("key").sortWithinPartitions("key", "doc")
    return rows.mapInArrow(run, "key long, doc long, hub long")


def sketch(own: np.ndarray) -> bytes:
    """The upper 16 bits of sorted hashes, as differences: first their low bytes, then the high ones, which are mostly zero and
    take no room once compressed. Two sets share at most as many elements as their sketches do as multisets."""
    steps = np.diff((own >> np.uint64(48)).astype(np.uint16), prepend=np.uint16(0)).astype("<u2")
    return steps.view(np.uint8).reshape(-1, 2).T.tobytes()


def numbered(raw: bytes) -> np.ndarray:
    """A sketch as a sorted set: each value with the number of equal ones before it, so that multisets intersect as sets."""
    low, high = np.frombuffer(raw, np.uint8).reshape(2, -1).astype(np.uint64)
    own = np.cumsum(low | high << np.uint64(8))
    place = np.arange(len(own))
    first = np.maximum.accumulate(np.where(np.concatenate([[True], own[1:] != own[:-1]]), place, 0)) if len(own) else place
    return own << np.uint64(32) | (place - first).astype(np.uint64)


def whole(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def element_sets(wanted: DataFrame, docs: DataFrame, words: int, text: str, key: str) -> DataFrame:
    """(doc, n, own, small) of at least the documents in wanted: the sorted hashes of their shingles and the sketch, from
    whole texts. The bitmap lets few others through, which no join needs; texts are shuffled only where it is too full."""

    def run(batches):
        for part, texts in sliced(batches, "t"):
            own = shingle_sets(texts, words)
            yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(map(len, own), pa.int64()), pa.array([x.tobytes() for x in own], pa.binary()), pa.array([sketch(x) for x in own], pa.binary())], names=["doc", "n", "own", "small"])

    likely, _ = parted(docs.selectExpr(f"CAST(`{key}` AS long) AS doc", f"`{text}` AS t"), F.col("doc"), wanted, "doc")
    if wanted.count() > 16 * WORDS:
        likely = likely.join(wanted, "doc")
    return likely.where("doc IS NOT NULL").select("doc", "t").mapInArrow(run, "doc long, n long, own binary, small binary")


def hub_links(pairs: DataFrame, sets: DataFrame, num: int, den: int, sketches: bool) -> DataFrame:
    """The pairs (doc, hub) that link, as (a, b). Sketches, if wanted, sort out most pairs that do not; the rest is held
    against each other with whole sets."""
    if not sketches:
        return hub_search(pairs, sets.select("doc", "own"), num, den, whole)
    open_ = materialise(hub_search(pairs, sets.select("doc", F.col("small").alias("own")), num, den, numbered), "open")
    return hub_search(open_.toDF("doc", "hub"), sets.select("doc", "own"), num, den, whole)


def hub_search(pairs: DataFrame, sets: DataFrame, num: int, den: int, decode) -> DataFrame:
    """Pairs (a, b) of (doc, hub) that share enough: each hub's set is searched over inverted lists of its documents, CHUNK
    at a time. The documents of a large hub are dealt over several tasks, each of which gets the hub's set."""
    parts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / DEAL).cast("int").alias("parts"))
    dealt = pairs.join(parts, "hub").select("doc", "hub", F.pmod(F.xxhash64("doc"), "parts").cast("int").alias("part"), F.lit(1).alias("is_doc"))
    heads = parts.select(F.col("hub").alias("doc"), "hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("is_doc"))

    def search(batches):
        hub, queries, held = None, [], []  # a hub whose id stands over different texts has a set of each

        def flush():
            index = InvertedLists([own for _, own in held])
            out = set()
            for query in queries:
                found = index.search(query, overlap_needed(index.sizes, len(query), num, den))
                out |= {held[r][0] for r, shared in found if den * shared >= num * (len(held[r][1]) + len(query) - shared)}
            held.clear()
            out = sorted(out)
            return pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), pa.array([hub] * len(out), pa.int64())], names=["a", "b"])

        for batch in batches:
            for h, is_doc, doc, raw in zip(*(batch.column(c).to_pylist() for c in ("hub", "is_doc", "doc", "own")), strict=True):
                if held and (h != hub or not is_doc or len(held) >= CHUNK):
                    yield flush()
                own = decode(raw)
                if is_doc:
                    held.append((doc, own))
                else:
                    queries = [*queries, own] if h == hub else [own]
                    hub = h
        if held:
            yield flush()

    rows = dealt.unionAll(heads).join(sets, "doc").repartition("hub", "part").sortWithinPartitions("hub", "part", "is_doc", "doc")
    return rows.select("hub", "is_doc", "doc", "own").mapInArrow(search, "a long, b long")


def unit_pairs(members: DataFrame, sets: DataFrame, num: int, den: int, column: str, decode) -> DataFrame:
    """Pairs (a, b) of different components within the units of members (doc, component, leader) whose sets, or
    sketches, share enough.

    A unit of more than ELEMENTS elements is cut into parts, every two of which meet once, so what a task holds is bounded
    and no pair of parts is left out. Every document outside the largest component is searched over the inverted lists of
    all others.
    """
    sized = members.join(sets.select("doc", "n"), "doc")
    parts = sized.groupBy("leader").agg(F.ceil(F.sum("n") / ELEMENTS).cast("int").alias("parts"))
    placed = members.join(parts, "leader").withColumn("part", F.pmod(F.xxhash64("doc"), "parts").cast("int"))
    units = placed.select("doc", "component", "leader", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    units = units.select("doc", "component", "leader", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")).distinct()

    def search(batches):
        unit, held = None, []

        def flush():
            docs, component, part, own = zip(*held, strict=True)
            i, j = unit[1:]
            out = []
            names, counts = np.unique(np.array(component), return_counts=True)
            if len(names) > 1:
                largest = names[counts.argmax()]
                index = InvertedLists(list(own))
                for q, query in enumerate(own):
                    if component[q] == largest:
                        continue
                    for r, shared in index.search(query, overlap_needed(index.sizes, len(query), num, den)):
                        if component[r] != component[q] and (i == j or part[r] != part[q]) and den * shared >= num * (len(own[r]) + len(query) - shared):
                            out.append((docs[q], docs[r]))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for c, i, j, part, doc, component, raw in zip(*(batch.column(x).to_pylist() for x in ("leader", "i", "j", "part", "doc", "component", "own")), strict=True):
                if held and (c, i, j) != unit:
                    yield flush()
                unit = (c, i, j)
                held.append((doc, component, part, decode(raw)))
        if held:
            yield flush()

    rows = units.join(sets.select("doc", F.col(column).alias("own")), "doc").repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j", "doc")
    return rows.select("leader", "i", "j", "part", "doc", "component", "own").mapInArrow(search, "a long, b long")


def jaccard_classes(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, text: str = "text", key: str = "doc_id", sketches: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest key reachable by links, itself included).

    A text's set holds its distinct lower-cased (A-Z) word shingles; with fewer words the whole sequence is one shingle.
    Two texts link when den * intersection >= num * union. Texts without words (null, empty) have no shingles and no link;
    rows with a null key keep a null component; rows with equal keys count as one document with the sets of each. `sketches`
    changes no result: it pays where many candidates miss the threshold, at low ones.
    """
    spark = docs.sparkSession
    small_batches(spark)
    keyed = materialise(signed(docs, words, num, den, text, key), "signed")
    members = materialise(block_members(keyed.where("size(keys) > 0")), "members")
    signatures = materialise(keyed.drop("keys"), "sizes")
    discard(spark, keyed)
    twins = signatures.where("n > 0 AND doc IS NOT NULL AND same = doc").groupBy("twin", "twin_2").agg(F.min("doc").alias("first"))
    equal = signatures.where("n > 0 AND doc IS NOT NULL").select("doc", "twin", "twin_2").join(twins, ["twin", "twin_2"]).where("doc <> first").selectExpr("doc AS a", "first AS b")
    size = signatures.where("doc IS NOT NULL").groupBy("doc").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    pairs = members.where("doc <> hub").select("doc", "hub").distinct().join(size, "doc").join(size.toDF("hub", "hub_lo", "hub_hi"), "hub")
    pairs = pairs.where(f"hi * {den} >= hub_lo * {num} AND hub_hi * {den} >= lo * {num}").select("doc", "hub")
    wanted = materialise(members.select("doc").distinct(), "wanted")
    sets = materialise(element_sets(wanted, docs, words, text, key), "sets", compression="zstd")
    links = hub_links(pairs, sets, num, den, sketches).unionAll(equal)
    labels = materialise(components(links), "labels")
    named = members.join(labels.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    # every document has been held against its block's hub; what is open are pairs of others in different components
    others = named.where("doc <> hub")
    mixed = others.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min("doc").alias("leader")).where("x <> y").select("key", "leader")
    rest = others.join(mixed, "key").groupBy("doc", "leader").agg(F.min("component").alias("component"))
    rest = materialise(rest, "rest")
    across = materialise(unit_pairs(rest, sets, num, den, *(("small", numbered) if sketches else ("own", whole))).selectExpr("greatest(a, b) AS doc", "least(a, b) AS hub").distinct(), "across")
    more = hub_search(across, sets.select("doc", "own"), num, den, whole)
    labels_2 = components(labels.selectExpr("node AS a", "component AS b").unionAll(more))
    out = signatures.selectExpr("doc", "n AS n_shingles").join(labels_2.withColumnRenamed("node", "doc"), "doc", "left")
    out = materialise(out.select(F.col("doc").alias("doc_id"), "n_shingles", F.coalesce("component", "doc").alias("component_id")), "classes")
    for table in (signatures, members, wanted, sets, labels, rest, across):
        discard(spark, table)
    return out


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, num=90, den=100, sketches=False)
