"""The pipeline deletes later copies of short lines too, with different lines around them."""

import corpus_pipeline


def test_line_dedup_of_short_lines(spark):
    rows = [(d, f"first of {d}\nAll rights reserved\n\nlast of {d}\nHome") for d in range(30)]
    docs = spark.createDataFrame([*rows, (30, "Home\nAll rights reserved")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert got == {0: rows[0][1]} | {d: f"first of {d}\n\nlast of {d}" for d in range(1, 30)}
