"""Approximate nearest neighbours: NN-descent by Spark joins, and greedy graph search (operator 5).

Distinct vectors are nodes, kept as the bytes of their components in the precision of the input, so near copies stay apart;
all distances are taken in double precision. Trees of median splits along random directions, fitted on a bounded sample about
its mean, deal all vectors into leaves of bounded size for a first neighbour list; each descent round meets the neighbours and
reverse neighbours of every node and offers each of them the closer ones. Queries walk the finished graph with a pool of best
nodes; the pool's head is scored on the original vectors.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import discard, materialise, scratch_path, small_batches

K = 24  # neighbours of a node
REVERSE = 24  # reverse neighbours that a node meets in a round, and that it leads to in a search beside its own
TREES = 6
LEAF = 256  # nodes of a leaf at most
SAMPLE = 1 << 20  # numbers of the sample that the trees are fitted on, at most: 16,384 vectors of 64 components
ROUNDS = 6
POOL = 320  # best nodes that a query keeps while it walks
BEAM = 128  # nodes that a query leaves at once
ENTRIES = 16  # nodes from which every query starts beside itself
HEAD = 48  # best nodes of the pool that are scored
LOOK = 500  # routes that a search measures at once


def complete_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Sorted batches regrouped so that rows with equal keys stand in one table; holds back the last group only."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        columns = [np.asarray(table.column(k)) for k in keys]
        end = tuple(c[-1] for c in columns)
        same = np.ones(table.num_rows, bool)
        for c, e in zip(columns, end, strict=True):
            same &= c == e
        cut = int(same.argmax())
        if last is not None and last != tuple(c[0] for c in columns) and held:
            yield pa.concat_tables(held).combine_chunks()
            held = []
        if cut:
            held.append(table.slice(0, cut))
            yield pa.concat_tables(held).combine_chunks()
            held = []
        held.append(table.slice(cut))
        last = end
    if held:
        yield pa.concat_tables(held).combine_chunks()


def array(table: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    return np.asarray(table.column(name))


def flat(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the length of each row's list."""
    column = table.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return np.asarray(column.flatten()), np.diff(np.asarray(column.offsets))


def lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, kind))


def decode(codes: list[bytes], kind: str) -> np.ndarray:
    """Vectors (rows, dimension) of codes, in double precision."""
    return np.frombuffer(b"".join(codes), kind).reshape(len(codes), -1).astype(np.float64)


def squared(v: np.ndarray) -> np.ndarray:
    """Squared distances of all rows; taken about their mean, so that a tight group far from zero keeps its digits."""
    v = v - v.mean(0)
    own = (v * v).sum(1)
    return np.maximum(own[:, None] + own - 2 * (v @ v.T), 0)


class Forest:
    """TREES trees that deal vectors into leaves: splits at the median of a sample, each along a random direction, as deep
    as the sample reaches; below that one bit for each of `extra` directions, by the side of the leaf's mean."""

    def __init__(self, sample: np.ndarray, n: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        bits = max(0, int(np.ceil(np.log2(max(1, n) / (LEAF * 0.75)))))
        self.depth = min(bits, max(0, int(np.log2(max(1, len(sample)) / 32))))
        self.extra = bits - self.depth
        dimension = sample.shape[1]
        self.planes = rng.normal(size=(TREES, (1 << self.depth) - 1, dimension))
        self.more = rng.normal(size=(TREES, dimension, self.extra + 1))
        self.cuts = np.zeros((TREES, (1 << self.depth) - 1))
        self.means = np.zeros((TREES, 1 << self.depth, dimension))
        for tree in range(TREES):
            node = np.zeros(len(sample), np.int64)
            for level in range(self.depth):
                base = (1 << level) - 1
                side = np.einsum("nd,nd->n", sample, self.planes[tree, base + node])
                for k in np.unique(node):
                    self.cuts[tree, base + k] = np.median(side[node == k])
                node = 2 * node + (side > self.cuts[tree, base + node])
            for k in np.unique(node):
                self.means[tree, k] = sample[node == k].mean(0)

    def leaves(self, v: np.ndarray, tree: int) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each vector, and its place along one more direction."""
        node = np.zeros(len(v), np.int64)
        for level in range(self.depth):
            at = (1 << level) - 1 + node
            node = 2 * node + (np.einsum("nd,nd->n", v, self.planes[tree, at]) > self.cuts[tree, at])
        side = (v - self.means[tree, node]) @ self.more[tree]
        return node << self.extra | ((side[:, : self.extra] > 0) << np.arange(self.extra)).sum(1), side[:, self.extra]


def nodes_of(vectors: DataFrame, dimension: int, n: int, kind: str) -> tuple[DataFrame, DataFrame]:
    """(id, code) and the leaf table (tree, leaf, place, id, code) of vectors (id, v); codes are of the numpy type kind."""

    def encode(v: np.ndarray) -> pa.Array:
        return pa.array([x.tobytes() for x in v.astype(kind)], pa.binary())

    def stack(batch: pa.RecordBatch) -> np.ndarray:
        return np.asarray(batch.column("v").flatten()).astype(np.float64).reshape(batch.num_rows, dimension)

    def codes(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("id"), encode(stack(batch))], names=["id", "code"])

    chosen = vectors.orderBy(F.xxhash64("id"), "id").limit(max(1, SAMPLE // dimension)).mapInArrow(codes, "id long, code binary").toArrow()
    sample = decode(chosen.column("code").to_pylist(), kind) if chosen.num_rows else np.zeros((0, dimension))
    mean = sample.mean(0) if len(sample) else np.zeros(dimension)
    forest = Forest(sample - mean, n)

    def leaves(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = stack(batch)
            raw = encode(v)
            v -= mean
            for tree in range(TREES):
                leaf, place = forest.leaves(v, tree)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), tree, np.int32)), pa.array(leaf), pa.array(place), batch.column("id"), raw], names=["tree", "leaf", "place", "id", "code"])

    return vectors.mapInArrow(codes, "id long, code binary"), vectors.mapInArrow(leaves, "tree int, leaf long, place double, id long, code binary")


OFFER = "id long, ids array<long>, dists array<float>, fresh array<boolean>"


def leaf_parts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Ids and codes of sorted rows (tree, leaf, id, code), LEAF of one leaf at a time; a last part takes what is left."""
    ids: list = []
    codes: list = []
    now = None
    for batch in batches:
        for tree, leaf, i, code in zip(*(batch.column(c).to_pylist() for c in ("tree", "leaf", "id", "code")), strict=True):
            if ids and ((tree, leaf) != now or len(ids) >= LEAF):
                yield np.array(ids), codes
                ids, codes = [], []
            now = tree, leaf
            ids.append(i)
            codes.append(code)
    if ids:
        yield np.array(ids), codes


def leaf_offers(leaves: DataFrame, kind: str) -> DataFrame:
    """The K nearest of each node within its leaf. Ranges of (tree, leaf, place) go to tasks, so a leaf that holds a large
    share of all nodes is dealt over many; LEAF neighbours along the place meet at most."""

    def run(batches):
        for ids, codes in leaf_parts(batches):
            if len(ids) < 2:
                continue
            d = squared(decode(codes, kind))
            np.fill_diagonal(d, np.inf)
            k = min(K, len(ids) - 1)
            best = np.argpartition(d, k - 1, 1)[:, :k]
            size = np.full(len(ids), k)
            yield pa.RecordBatch.from_arrays([pa.array(ids), lists(ids[best].ravel(), size, pa.int64()), lists(np.take_along_axis(d, best, 1).ravel(), size, pa.float32()), lists(np.ones(k * len(ids), bool), size, pa.bool_())], names=["id", "ids", "dists", "fresh"])

    rows = leaves.repartitionByRange("tree", "leaf", "place", "id").sortWithinPartitions("tree", "leaf", "place", "id")
    return rows.mapInArrow(run, OFFER)


def best_offers(table: pa.Table) -> pa.RecordBatch:
    """One row per id in ascending order: its K nearest of all offers; an entry that was there before is not fresh."""
    near, sizes = flat(table, "ids")
    dist, fresh = flat(table, "dists")[0], flat(table, "fresh")[0]
    owner = np.repeat(array(table, "id"), sizes)
    order = np.lexsort((fresh, near, owner))
    owner, near, dist, fresh = owner[order], near[order], dist[order], fresh[order]
    first = np.ones(len(owner), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (near[1:] != near[:-1])
    owner, near, dist, fresh = owner[first], near[first], dist[first], fresh[first]
    order = np.lexsort((near, dist, owner))
    owner, near, dist, fresh = owner[order], near[order], dist[order], fresh[order]
    start = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.empty(0, int)
    count = np.diff(np.append(start, len(owner)))
    keep = np.arange(len(owner)) - np.repeat(start, count) < K
    size = np.minimum(count, K)
    return pa.RecordBatch.from_arrays([pa.array(owner[start]), lists(near[keep], size, pa.int64()), lists(dist[keep], size, pa.float32()), lists(fresh[keep], size, pa.bool_())], names=["id", "ids", "dists", "fresh"])


def merged(offers: DataFrame) -> DataFrame:
    """One list per node: its K nearest of all offers. Each batch is condensed at once; of a node with very many offers
    only the best so far are held."""

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = best_offers(pa.Table.from_batches([batch] if held is None else [held, batch]))
            if now.num_rows:
                yield now.slice(0, now.num_rows - 1)
                held = now.slice(now.num_rows - 1)
        if held is not None:
            yield held

    return offers.repartition("id").sortWithinPartitions("id").mapInArrow(run, OFFER)


def meetings(graph: DataFrame, codes: DataFrame, kind: str) -> DataFrame:
    """What a round offers: at each centre, its neighbours and up to REVERSE reverse neighbours (chosen by hash) meet; a pair
    with a fresh member is offered to whichever of both it is closer to than its present worst neighbour. Reverse edges are
    chosen, and centres without a fresh one left out, before any vector travels."""

    def meet(batches):
        for table in complete_groups(batches, ["centre"]):
            centre, ids, new, worst = (array(table, c) for c in ("centre", "id", "new", "worst"))
            v = decode(table.column("code").to_pylist(), kind)
            edge = np.flatnonzero(np.concatenate([[True], centre[1:] != centre[:-1], [True]]))
            out = []
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if b - a < 2:
                    continue
                own = slice(a, b)
                d = squared(v[own])
                good = (d < worst[own][:, None]) & (new[own][:, None] | new[own])
                np.fill_diagonal(good, False)
                to, of = np.nonzero(good)
                if len(to):
                    out.append((ids[own][to], ids[own][of], d[to, of]))
            if out:
                to, of, d = (np.concatenate(x) for x in zip(*out, strict=True))
                order = np.lexsort((d, of, to))
                to, of, d = to[order], of[order], d[order]
                first = np.concatenate([[True], (to[1:] != to[:-1]) | (of[1:] != of[:-1])])
                to, of, d = to[first], of[first], d[first]
                start = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
                size = np.diff(np.append(start, len(to)))
                yield pa.RecordBatch.from_arrays([pa.array(to[start]), lists(of, size, pa.int64()), lists(d, size, pa.float32()), lists(np.ones(len(of), bool), size, pa.bool_())], names=["id", "ids", "dists", "fresh"])

    edges = graph.select("id", F.explode(F.arrays_zip("ids", "fresh")).alias("e")).select(F.col("id").alias("centre"), F.col("e.ids").alias("id"), F.col("e.fresh").alias("new"))
    back = edges.select(F.col("id").alias("centre"), F.col("centre").alias("id"), "new")
    back = back.withColumn("r", F.expr("row_number() OVER (PARTITION BY centre ORDER BY xxhash64(centre, id))")).where(f"r <= {REVERSE}").drop("r")
    met = edges.unionAll(back).groupBy("centre").agg(F.collect_list(F.struct("id", "new")).alias("met")).where("exists(met, x -> x.new)")
    own = F.transform(F.array_distinct(F.transform("met", lambda x: x["id"])), lambda i: F.struct(i.alias("id"), F.exists("met", lambda x: (x["id"] == i) & x["new"]).alias("new")))
    pairs = met.select("centre", F.explode(own).alias("m")).select("centre", "m.id", "m.new")
    worst = graph.select("id", F.when(F.size("ids") < K, F.lit(float("inf"))).otherwise(F.element_at("dists", -1)).cast("double").alias("worst"))
    about = codes.join(worst, "id")
    rows = pairs.join(about, "id").repartition("centre").sortWithinPartitions("centre", "id")
    return rows.mapInArrow(meet, OFFER)


def descend(codes: DataFrame, leaves: DataFrame, kind: str) -> DataFrame:
    """The neighbour graph (id, ids, dists, fresh); rounds end early when less than one of 200 entries is fresh."""
    spark = codes.sparkSession
    graph = materialise(merged(leaf_offers(leaves, kind)), "graph")
    for _ in range(ROUNDS):
        offers = meetings(graph, codes, kind).unionAll(graph.withColumn("fresh", F.transform("fresh", lambda x: F.lit(False))))
        after = materialise(merged(offers), "graph")
        changed, entries = after.agg(F.sum(F.size(F.filter("fresh", lambda x: x))), F.sum(F.size("ids"))).first()
        discard(spark, graph)
        graph = after
        if not entries or changed < entries / 200:
            break
    return graph


def routes(graph: DataFrame, codes: DataFrame) -> DataFrame:
    """(id, ids, codes): what a search sees from a node: its neighbours and its nearest REVERSE reverse neighbours."""
    edges = graph.select("id", F.explode(F.arrays_zip("ids", "dists")).alias("e")).select("id", F.col("e.ids").alias("to"), F.col("e.dists").alias("d"))
    back = edges.select(F.col("to").alias("id"), F.col("id").alias("to"), "d").withColumn("r", F.expr("row_number() OVER (PARTITION BY id ORDER BY d, to)"))
    both = edges.select("id", "to", "d", F.lit(False).alias("back")).unionAll(back.where(f"r <= {REVERSE + K}").select("id", "to", "d", F.lit(True).alias("back")))
    seen = both.join(codes.withColumnRenamed("id", "to"), "to")

    def run(batches):
        for table in complete_groups(batches, ["id"]):
            own, to, back = array(table, "id"), array(table, "to"), array(table, "back")
            code = table.column("code").to_pylist()
            edge = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
            rows = []
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                at = np.arange(a, b)
                known = set(to[at[~back[at]]].tolist())
                more = [i for i in at[back[at]].tolist() if int(to[i]) not in known][:REVERSE]
                at = [*at[~back[at]].tolist(), *more]
                rows.append((own[a], to[at], b"".join(code[i] for i in at)))
            size = [len(r[1]) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), lists(np.concatenate([r[1] for r in rows]), size, pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["id", "ids", "codes"])

    return seen.repartition("id").sortWithinPartitions("id", "d", "to").mapInArrow(run, "id long, ids array<long>, codes binary")


STATE = "query long, code binary, pool array<long>, dists array<double>, left array<boolean>"


def walk(queries: DataFrame, way: DataFrame, entries: list[tuple], kind: str) -> DataFrame:
    """(query, pool, dists): the best POOL nodes that each query (query, code) reaches on the graph.

    In each step a query leaves up to BEAM best nodes of its pool that it has not left yet; it ends when none remains.
    """
    spark = queries.sparkSession
    entry_ids = np.array([e[0] for e in entries], np.int64)
    entry_vectors = decode([bytes(e[1]) for e in entries], kind)

    def begin(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            v, query = decode(table.column("code").to_pylist(), kind), array(table, "query")
            d = np.stack([((v - e) ** 2).sum(1) for e in entry_vectors], 1)
            pools = [dict(zip([int(q), *entry_ids.tolist()], [0.0, *row.tolist()], strict=True)) for q, row in zip(query, d, strict=True)]
            yield state(table, [sorted(p.items(), key=lambda x: (x[1], x[0])) for p in pools], [set() for _ in pools])

    def state(table, pools, gone):
        size = [len(p) for p in pools]
        return pa.RecordBatch.from_arrays(
            [table.column(c).combine_chunks() if isinstance(table.column(c), pa.ChunkedArray) else table.column(c) for c in ("query", "code")]
            + [lists([i for p in pools for i, _ in p], size, pa.int64()), lists([d for p in pools for _, d in p], size, pa.float64()), lists([i in g for p, g in zip(pools, gone, strict=True) for i, _ in p], size, pa.bool_())],
            names=["query", "code", "pool", "dists", "left"],
        )

    def look(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, LOOK):
                part = batch.slice(at, LOOK)
                v = decode(part.column("code").to_pylist(), kind)
                near, sizes = flat(pa.Table.from_batches([part]), "ids")
                raw = np.frombuffer(b"".join(part.column("codes").to_pylist()), kind).reshape(len(near), v.shape[1])
                d = ((raw - np.repeat(v, sizes, 0)) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([part.column("query"), part.column("id"), lists(near, sizes, pa.int64()), lists(d, sizes, pa.float64())], names=["query", "id", "ids", "near"])

    def take(batches):
        for table in complete_groups(batches, ["query"]):
            query, kind = array(table, "query"), array(table, "kind")
            edge = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1], [True]]))
            ids, dists, left = table.column("pool").to_pylist(), table.column("dists").to_pylist(), table.column("left").to_pylist()
            rows, pools, gone = [], [], []
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                pool: dict = {}
                over: set = set()
                for i in range(a, b):
                    pool.update(zip(ids[i], dists[i], strict=True))
                    over.update(x for x, o in zip(ids[i], left[i], strict=True) if o) if kind[i] == 0 else over.add(kind[i] - 1)
                rows.append(a)
                pools.append(sorted(pool.items(), key=lambda x: (x[1], x[0]))[:POOL])
                gone.append(over)
            yield state(table.take(rows), pools, gone)

    now = materialise(queries.mapInArrow(begin, STATE), "walk")
    while True:
        leave = F.slice(F.filter(F.arrays_zip("pool", "left"), lambda x: ~x["left"]), 1, BEAM)
        going = now.select("query", "code", F.explode(leave).alias("e")).select("query", "code", F.col("e.pool").alias("id"))
        if going.isEmpty():
            return now.select("query", "pool", "dists")
        seen = [F.coalesce("ids", F.array().cast("array<long>")).alias("ids"), F.coalesce("codes", F.lit(b"")).alias("codes")]
        looked = going.join(way, "id", "left").select("query", "code", "id", *seen).mapInArrow(look, "query long, id long, ids array<long>, near array<double>")
        empty = F.lit(None).cast("binary").alias("code")
        rows = now.withColumn("kind", F.lit(0).cast("long")).unionByName(looked.select("query", empty, F.col("ids").alias("pool"), F.col("near").alias("dists"), F.transform("ids", lambda x: F.lit(False)).alias("left"), (F.col("id") + 1).alias("kind")))
        after = materialise(rows.repartition("query").sortWithinPartitions("query", F.col("kind") != 0).mapInArrow(take, STATE), "walk")
        discard(spark, now)
        now = after


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest other rows found for each query, by Euclidean distance.

    `queries` names query ids (column key). Vectors that are null, zero, of another dimension than most, or hold null or
    non-finite components take no part, as query or candidate; so do rows with a null id. Equal vectors are one node of the
    graph; each of them is a candidate, ties go to the smaller id. With fewer candidates than k all are returned; an empty
    table gives no rows. Scores are computed in double precision on the original vectors.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    kind = "<f4" if vectors.schema[vector].dataType.elementType.typeName() == "float" else "<f8"
    clean = f"`{vector}` IS NOT NULL AND forall(`{vector}`, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(`{vector}`, x -> x <> 0)"
    valid = vectors.where(f"`{key}` IS NOT NULL").where(clean).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).dropDuplicates(["id"])
    top = valid.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if top is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dimension = top["d"]
    valid = materialise(valid.where(F.size("v") == dimension), "vectors")
    leaders = valid.groupBy("v").agg(F.min("id").alias("node"))
    members = materialise(valid.join(leaders, "v").select("id", "node"), "members")
    distinct = valid.join(members.where("id = node").select("id"), "id", "left_semi")
    n = distinct.count()
    codes, leaves = nodes_of(distinct, dimension, n, kind)
    codes = materialise(codes, "codes")
    entries = [tuple(r) for r in codes.orderBy(F.xxhash64("id"), "id").limit(ENTRIES).collect()]
    graph = descend(codes, leaves, kind)
    way = f"quire_way_{uuid.uuid4().hex}"
    asked = members.join(queries.select(F.col(key).cast("long").alias("id")).distinct(), "id", "left_semi")
    start = asked.select(F.col("node").alias("id")).distinct().join(codes, "id").selectExpr("id AS query", "code")
    place = scratch_path(spark, "routes")
    try:
        # buckets by id: every step of the walk joins them without a shuffle of vectors
        routes(graph, codes).write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "id").option("path", place).saveAsTable(way)
        pools = walk(start, spark.table(way), entries, kind)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {way}")
        discard(spark, place)
    found = pools.select("query", F.explode(F.slice("pool", 1, HEAD)).alias("node"))
    # equal vectors: the k + 1 smallest ids of each node, first per salt and then together
    spread = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(32)))
    for by in (["node", "salt"], ["node"]):
        spread = spread.withColumn("r", F.expr(f"row_number() OVER (PARTITION BY {', '.join(by)} ORDER BY id)")).where(f"r <= {k + 1}")
    spread = spread.select("node", "id")
    at = valid.selectExpr("id AS node", "v AS nv")
    gap = F.sqrt(F.aggregate(F.zip_with("qv", "nv", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    measured = found.join(at, "node").join(valid.selectExpr("id AS query", "v AS qv"), "query").select("query", "node", gap.alias("score"))
    pairs = asked.selectExpr("id AS query_id", "node AS query").join(measured, "query").join(spread.selectExpr("node", "id AS vec_id"), "node").where("query_id <> vec_id")
    out = pairs.withColumn("rank", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)")).where(f"rank <= {k}").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    out = materialise(out, "nearest")
    for table in (valid, members, codes, graph, pools):
        discard(spark, table)
    return out


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where("vec_id % 100 = 0").select("vec_id"))
