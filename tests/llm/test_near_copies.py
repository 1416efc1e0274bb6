"""Neighbours within groups of near copies, which differ by less than a byte per component can tell."""

import numpy as np
import pytest

from quire.llm.neighbours import nearest


@pytest.mark.parametrize(("kind", "noise"), [("float", 0.0001), ("double", 1e-9)])
def test_recall_in_groups_of_near_copies(spark, kind, noise):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(3, 64))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    vectors = np.concatenate([c + noise * rng.normal(size=(500, 64)) for c in centres])
    vectors = vectors.astype(np.float32).astype(float) if kind == "float" else vectors
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], f"vec_id long, embedding array<{kind}>")
    found = {}
    for r in nearest(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    right = [len(set(found[q]) & set([i for i in np.argsort(((vectors - vectors[q]) ** 2).sum(1), kind="stable") if i != q][:10])) for q in range(0, 1500, 50)]
    assert np.mean(right) >= 9, np.mean(right)
