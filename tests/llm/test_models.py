import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from quire.llm.language import WINDOW, WIDTHS, ByteNet, identify, predict, windows
from quire.llm.lines import drop_later_lines
from quire.llm.neighbours import LEAF, Forest, complete_groups, leaf_parts, nearest
from quire.llm.prune import parted
from quire.llm.quality import FEATURES, LineField, assess, base, fit_field, keep_good, train

SMALL = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# language


def test_pooling_equals_a_direct_convolution():
    rng = np.random.default_rng(1)
    net = ByteNet(["a", "b"], rng.normal(size=(256, sum(WIDTHS), 3)).astype(np.float32), rng.normal(size=9).astype(np.float32), rng.normal(size=(9, 2)).astype(np.float32), np.zeros(2, np.float32))
    x = rng.integers(0, 256, (4, 20)).astype(np.uint8)
    at, want = 0, []
    for width in WIDTHS:
        want.append(np.max([sum(net.kernel[x[:, p + j], at + j] for j in range(width)) for p in range(20 - width + 1)], 0))
        at += width
    assert np.allclose(net.pooled(x), np.maximum(np.concatenate(want, 1) + net.bias, 0), atol=1e-4)


def test_windows_cover_whole_texts():
    raw = [b"", b"x" * (WINDOW - 1), b"y" * WINDOW, b"z" * (3 * WINDOW + 5)]
    ends = np.cumsum([len(r) for r in raw])
    x, filled, count = windows(np.frombuffer(b"".join(raw), np.uint8), ends - [len(r) for r in raw], ends)
    assert count.tolist() == [0, 1, 1, 4] and filled.sum() == ends[-1] and x.shape == (6, WINDOW)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = __spark_entry__.queries()["op1_language"](spark, SMALL).join(docs, "doc_id").where("held_out AND length(text) > 40")
    n, right = got.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 150 and right / n > 0.97
    assert got.where("score < 0 OR score > 1").count() == 0


def test_language_of_awkward_texts(docs, rows, none, spark):
    labelled = docs.where("text IS NOT NULL AND lang IS NOT NULL").limit(30)
    got = identify(docs, labelled).collect()
    assert len(got) == len(rows)
    by_text = Counter(r.lang_pred for r in got)
    assert by_text["und"] == sum(not any(c.isalpha() for c in t or "") for _, t, *_ in rows)
    assert identify(none, labelled).count() == 0
    assert {(r.lang_pred, r.score) for r in identify(docs, none).collect()} == {("und", 0.0)}


def test_unknown_texts_are_und():
    net = ByteNet(["a"], np.zeros((256, sum(WIDTHS), 2), np.float32), np.zeros(6, np.float32), np.zeros((6, 1), np.float32), np.zeros(1, np.float32))
    assert predict(net, ["", "1 2", "x"]) == (["und", "und", "a"], [0.0, 0.0, 1.0])


# quality


def brute_base(text: str) -> tuple:
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count, hit = Counter(grams), [False] * len(words)
    for i, g in enumerate(grams):
        if count[g] > 1:
            hit[i : i + 5] = [True] * 5
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), sum(hit)


def test_base_statistics(docs, rows, none):
    got = sorted((tuple(r[:7]) for r in assess(docs, None).collect()), key=str)
    want = []
    for i, t, *_ in rows:
        own = brute_base(t or "")
        want.append((i, *own, own[0] < 10 or 100 * own[4] > 20 * own[0]))
    assert got == sorted(want, key=str) and assess(none, None).count() == 0


def test_base_on_random_texts():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["a ", "b ", "c\n", "é\t", "# ", "\n", "\xa0x ", "long "]) for _ in range(rng.randint(0, 60)))
        raw = text.encode()
        keys = raw.split(b"\n")
        assert base(text, raw, [k.split() for k in keys], keys) == brute_base(text)


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(3)
    for _ in range(50):
        field = LineField(np.zeros((FEATURES, 2)), rng.normal(size=(2, 2)))
        scores = rng.normal(size=(6, 2))
        value = lambda y: sum(scores[i, k] for i, k in enumerate(y)) + sum(field.transition[a, b] for a, b in zip(y, y[1:]))
        best = max((tuple(int(c) for c in f"{k:06b}") for k in range(64)), key=value)
        assert tuple(field.decode(scores)) == best


def test_training_separates_lines():
    rng = np.random.default_rng(4)
    good = [np.column_stack([np.ones(5), *rng.random((FEATURES - 1, 5)) * 0.2]) for _ in range(30)]
    bad = [np.column_stack([np.ones(4), *(0.6 + rng.random((FEATURES - 1, 4)) * 0.4)]) for _ in range(20)]
    field = fit_field(good + bad, [0] * 30 + [1] * 20)
    assert all(field.decode(x @ field.emission) == [0] * 5 for x in good) and all(field.decode(x @ field.emission) == [1] * 4 for x in bad)


def test_labelled_documents_are_told_apart(spark, none):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    field = train(docs, labels)
    got = {r.quality: r.share for r in assess(docs, field).where("NOT base_failed").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert got[1] > 0.98 and got[0] < 0.1
    kept = keep_good(docs, field)
    assert kept.columns == docs.columns and kept.count() == assess(docs, field).where("kept").count()
    assert train(none, labels) is None and train(docs, labels.where("quality = 1")) is None
    assert keep_good(none, field).count() == 0


def test_shares_of_content_vary(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    field = train(docs, labels)
    shares = [r.content_share for r in assess(docs, field).where("NOT base_failed").collect()]
    assert sum(0.02 < x < 0.98 for x in shares) > 0.02 * len(shares)
    good = docs.join(labels.where("quality = 1"), "doc_id").where("length(text) > 1500").orderBy("doc_id").limit(12)
    menu = "\n".join(["*** %% $$ ## &&& *** %%% $$$ ###"] * 3) + "\n"
    headed = good.select("doc_id", F.concat(F.lit(menu), "text").alias("text"))
    got = assess(headed, field).where("NOT base_failed").collect()
    assert got and all(r.kept and 0.5 < r.content_share < 1 for r in got)


# neighbours


@pytest.mark.parametrize("kind", ["offset", "clusters", "copies", "spread"])
def test_recall_on_uneven_vectors(spark, kind):
    rng = np.random.default_rng(12)
    noise = rng.normal(size=(2000, 32))
    v = {"offset": 0.01 * noise + 5 * (np.arange(32) == 0), "clusters": rng.normal(size=(25, 32))[rng.integers(0, 25, 2000)] + 0.01 * noise, "copies": np.where(np.arange(2000)[:, None] % 3 == 0, noise[0], noise), "spread": noise}[kind].astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    found = {}
    for r in nearest(df, df.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    right = []
    for q, got in found.items():
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        d[q] = np.inf
        limit = np.sort(d)[9]
        right.append(sum(s <= limit + 1e-12 for _, s in got))
        assert got == sorted(got, key=lambda x: (x[1], x[0])) and all(abs(d[i] - s) < 1e-9 for i, s in got)
    assert len(found) == 20 and np.mean(right) >= 9


def test_recall_on_the_table(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = {r.vec_id: r.embedding for r in df.collect() if r.embedding is not None and None not in r.embedding and np.isfinite(r.embedding).all() and any(r.embedding)}
    found = {}
    for r in __spark_entry__.queries()["op5_neighbours"](spark, SMALL).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert sorted(found) == sorted(i for i in rows if i % 100 == 0)
    assert np.mean([len(found[q] & {i for i, _ in brute_nearest(rows, q)}) for q in found]) >= 9


def test_leaves_are_bounded():
    rng = np.random.default_rng(2)
    for v in (rng.normal(size=(6000, 8)), np.eye(8)[0] * 5 + 0.001 * rng.normal(size=(6000, 8)), rng.normal(size=(3, 8))[rng.integers(0, 3, 6000)] + 0.001 * rng.normal(size=(6000, 8))):
        forest = Forest(v[:2048] - v[:2048].mean(0), len(v))
        leaf, place = forest.leaves(v - v[:2048].mean(0), 0)
        assert np.bincount(leaf).max() < 8 * LEAF
        order = np.lexsort((place, leaf))
        rows = [(0, int(leaf[i]), int(i), b"x") for i in order]
        for size in (100, 1000):
            batches = [pa.RecordBatch.from_pydict(dict(zip(("tree", "leaf", "id", "code"), zip(*rows[k : k + size])))) for k in range(0, len(rows), size)]
            parts = [ids for ids, _ in leaf_parts(batches)]
            assert max(map(len, parts)) <= LEAF and np.concatenate(parts).tolist() == order.tolist() and all(len(set(leaf[p])) == 1 for p in parts)


def brute_nearest(rows: dict, query: int, k: int = 10) -> list:
    q = np.array(rows[query], float)
    gaps = sorted((float(np.sqrt(((np.array(v, float) - q) ** 2).sum())), i) for i, v in rows.items() if i != query)
    return [(i, round(d, 9)) for d, i in gaps[:k]]


def test_recall(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(1500, 16))
    rows = {i * 3: v.tolist() for i, v in enumerate(vectors)}
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>")
    got = nearest(df, df.where("vec_id % 100 = 0"))
    found = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
    assert sorted(found) == [i for i in rows if i % 100 == 0]
    right = [len({i for i, _ in found[q]} & {i for i, _ in brute_nearest(rows, q)}) for q in found]
    assert np.mean(right) >= 9 and all(len(v) == 10 and v == sorted(v, key=lambda x: (x[1], x[0])) for v in found.values())


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    own = {0: [1.0, 0.0], 1: [1.0, 0.0], 2: [1.0, 0.0], 3: [0.0, 1.0], 4: [0.0, 2.0], 100: [0.0, 1.0], 200: [5.0, 5.0]}
    bad = [(5, None), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (300, [0.0, 0.0]), (400, [1.0]), (None, [1.0, 1.0]), (3, [0.0, 1.0])]
    df = spark.createDataFrame([*own.items(), *bad], "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).withColumn("rank", F.lit(2))
    got = {}
    for r in nearest(df, df.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
    assert got == {q: brute_nearest(own, q) for q in (0, 100, 200)}
    assert nearest(df.where("vec_id IN (5, 6)"), df).count() == 0 and nearest(df.where("vec_id = 0"), df).count() == 0


def test_many_equal_vectors(spark):
    df = spark.range(400).selectExpr("id AS vec_id", "CASE WHEN id < 350 THEN array(1.0D, 0.0D) ELSE array(0.0D, CAST(id AS double)) END AS embedding")
    got = nearest(df, df.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in got if r.query_id == 100] == list(range(10)) and [r.vec_id for r in got if r.query_id == 0] == list(range(1, 11))


def test_groups_stay_together():
    rows = [(k, i) for k in range(7) for i in range(k * 3 % 5 + 1)]
    for size in (1, 2, 3, 100):
        batches = [pa.RecordBatch.from_pydict({"k": [r[0] for r in rows[i : i + size]], "i": [r[1] for r in rows[i : i + size]]}) for i in range(0, len(rows), size)]
        tables = [t.column("k").to_pylist() for t in complete_groups(batches, ["k"])]
        assert [k for t in tables for k in t] == [r[0] for r in rows]
        assert all(not set(a) & set(b) for i, a in enumerate(tables) for b in tables[i + 1 :])


def test_bitmap_never_loses_a_row(spark):
    rows = spark.range(5000).selectExpr("id AS k", "id % 7 AS x").unionAll(spark.sql("SELECT CAST(NULL AS long), 1L"))
    wanted = spark.range(0, 5000, 50).selectExpr("id AS w").unionAll(spark.sql("SELECT CAST(NULL AS long)"))
    likely, rest = parted(rows, F.col("k"), wanted, "w")
    assert likely.columns == rest.columns == ["k", "x"] and likely.count() + rest.count() == 5001
    assert likely.join(wanted, F.col("k") == F.col("w")).count() == 100 and likely.count() < 200


# pipeline


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "substring_dedup", "packing"]
    seen, counts = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialise(stage(spark, seen, SMALL), name)
        assert sorted(out.columns) == sorted(docs.columns) and out.select("doc_id").distinct().count() == out.count() <= counts[-1]
        counts.append(out.count())
        seen = out
    assert counts[1] < counts[0] and counts[2] < counts[1] and counts[4] == counts[3]
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    packed = corpus_pipeline.STAGES[-1][1](spark, seen, SMALL)
    assert packed.select("doc_id").distinct().count() == counts[-1]
    assert seen.join(labels.where("quality = 0"), "doc_id").count() < 8


def test_pipeline_takes_awkward_tables(spark, docs, none):
    for table in (docs, none):
        seen = table.select("doc_id", "text", "lang", "source", "n_chars", "gone", "t")
        for name, stage in corpus_pipeline.STAGES:
            seen = corpus_pipeline.materialise(stage(spark, seen, SMALL), name)
            if name != "packing":
                assert seen.columns == ["doc_id", "text", "lang", "source", "n_chars", "gone", "t"]
        assert (seen.count() > 0) == (table is docs)


def test_line_dedup_keeps_clean_documents(spark):
    rows = [(k, f"document {k} says something of its own in its only line {k * k}") for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, drop_later_lines(df).collect())) == rows
