"""Figure and heading operators on small pages worked out by hand, and order-independence."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import figures as fig
from quire.operators import lines, sections

BLOCK = "doc_id int, page_no int, block_no int, y0 double, y1 double, text string"
BODY = "This is a paragraph of ordinary body text that goes on for a while, as text does."


def detect(spark, blocks, images=()):
    b = spark.createDataFrame([(1, p, k, y0, y1, t) for k, (p, y0, y1, t) in enumerate(blocks)], BLOCK)
    pages = b.select("doc_id", "page_no").distinct().withColumn("height", F.lit(800.0))
    i = spark.createDataFrame([(1, p, k, y0, y1) for k, (p, y0, y1) in enumerate(images)], "doc_id int, page_no int, img_no int, y0 double, y1 double")
    return {r.id: r for r in fig.figure_map(fig.extents(fig.captions(b, pages), b, i)).collect()}


def test_walk_takes_rows_and_stops_at_body_text(spark):
    page = [(1, 100.0, 112.0, "Table 1. Yields"), (1, 114.0, 126.0, "1 Nickel 90%"), (1, 128.0, 140.0, "2 Iron 5%"), (1, 142.0, 154.0, BODY), (1, 156.0, 168.0, "3 Zinc 1%"), (1, 780.0, 790.0, "7")]
    got = detect(spark, page)["table-01_p1"]
    assert (got.y_start, got.y_end, got.height_pt, got.title_only) == (0.125, 0.175, 40.0, False)


def test_figure_above_its_caption(spark):
    page = [(1, 20.0, 32.0, "Some heading"), (1, 300.0, 312.0, "Figure 2. A mechanism"), (1, 314.0, 326.0, BODY)]
    got = detect(spark, page)["figure-02_p1"]
    assert (got.y_start, got.y_end) == (round(34 / 800, 4), round(318 / 800, 4))


def test_images_extend_and_the_next_caption_bounds(spark):
    page = [(1, 50.0, 62.0, "Scheme 1"), (1, 300.0, 312.0, "Scheme 2")]
    got = detect(spark, page, [(1, 70.0, 200.0), (1, 320.0, 500.0)])
    assert got["scheme-01_p1"].y_end == 200 / 800 and got["scheme-02_p1"].y_end == 500 / 800


def test_captions_at_the_end_of_a_page_are_titles_only(spark):
    got = detect(spark, [(1, 20.0, 32.0, BODY), (1, 700.0, 712.0, "Table 3. Continued overleaf")])
    assert got["table-03_p1"].title_only


def test_sentences_that_cite_are_no_captions(spark):
    own = spark.createDataFrame([("Table 1 中比較不同配體",), ("Table 2 所示。當使用",), ("Table 4. Yields of products",), ("Fig. 3 A plot",), ("表 5 結果",), ("Tables in general",), ("Table 6 " + "x" * 120,)], "t string")
    assert [r[0] for r in own.select(fig.caption(F.col("t"))).collect()] == [False, False, True, True, True, False, False]


def test_findings_of_tables_and_files(spark):
    own = spark.createDataFrame([(1, "table-01_p1", 0.0, 100.0, "1 a\n2 b\nGC yield", False, 0.0, 110.0), (1, "table-02_p1", 0.0, 100.0, "nothing", False, 0.0, 103.0), (1, "table-03_p1", 0.0, 100.0, "1 a", False, 0.0, None), (1, "table-04_p1", 0.0, 200.0, "", True, 80.0, None), (1, "figure-01_p1", 0.0, 9.0, "", False, 0.0, None)], "doc_id int, id string, y0 double, y1 double, text string, image_table boolean, overlap double, next_y double")
    got = {(r.id, r.code) for r in fig.audit_tables(own).collect()}
    assert got == {("table-02_p1", "no_rows"), ("table-02_p1", "no_footnote"), ("table-02_p1", "tight_below"), ("table-03_p1", "one_row"), ("table-03_p1", "no_footnote"), ("table-04_p1", "image_cut")}
    files = spark.createDataFrame([("table-01_p1.png", 9000), ("table-02_p1.png", 10)], "name string, length long")
    assert {(r.id, r.problem) for r in fig.crop_files(own, files).collect()} == {("table-02_p1", "tiny"), ("table-03_p1", "missing"), ("table-04_p1", "missing"), ("figure-01_p1", "missing")}
    sized = own.withColumn("height_pt", F.col("y1") - F.col("y0"))
    seen = {(r.id, r.reason) for r in fig.must_view(sized, fig.audit_tables(own)).collect()}
    assert ("figure-01_p1", "lowest") in seen and ("table-04_p1", "highest") in seen and ("table-02_p1", "finding") in seen and ("table-01_p1", "finding") not in seen


def test_images_belong_to_the_nearest_caption(spark):
    caps = spark.createDataFrame([(1, 1, 1, 100.0), (1, 1, 2, 400.0)], "doc_id int, page_no int, cap_no int, y0 double")
    images = spark.createDataFrame([(1, 1, 1, 110.0, 200.0), (1, 1, 2, 300.0, 380.0)], "doc_id int, page_no int, img_no int, y0 double, y1 double")
    assert {r.img_no: r.cap_no for r in fig.image_claims(caps, images).collect()} == {1: 1, 2: 2}


def test_gate_orders_bad_before_pending(spark):
    verdict = lambda *s: fig.gate(spark.createDataFrame([(x,) for x in s], "status string")).first().verdict
    assert verdict("ok", "fixed") == "pass" and verdict("pending", "bad") == "bad" and verdict("ok", "pending") == "pending"


def test_sections_reproduce_the_text_in_any_partitioning(spark):
    texts = [(k, "\n".join(f"# Part {i}" if i % 4 == 1 else f"line {i} of {k}" for i in range(k % 17 + 1))) for k in range(60)]
    own = spark.createDataFrame(texts, "doc_id int, text string")
    for n in (1, 7):
        found = sections.sections(lines.explode_lines(own).repartition(n), sections.heading_splits(1))
        joined = found.groupBy("doc_id").agg(F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("sec_no", "lines"))), lambda s: s["lines"])), "\n").alias("t"))
        assert {r.doc_id: r.t for r in joined.collect()} == dict(texts)


def test_repairs_are_stable(spark):
    texts = [("a\n\n\n\nb  ",), ("|  |\n| --- |\n|  |\nx",), ("",), ("�" * 5,), ("é　\n",), (None,)]
    own = spark.createDataFrame(texts, "t string")
    once = [r[0] for r in own.select(text.post_process(F.col("t"))).collect()]
    twice = [r[0] for r in spark.createDataFrame([(x,) for x in once], "t string").select(text.post_process(F.col("t"))).collect()]
    assert once == twice and once[3] == "---\n" and once[4] == "\xe9\n" and once[5] is None


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("ab \n\r\t　\x85 é", max_size=12), min_size=1, max_size=6))
def test_line_functions_equal_python(spark, texts):
    own = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    rows = own.select("t", text.split_lines(F.col("t")).alias("lines"), text.strip(F.col("t")).alias("bare"), text.anchor_key(F.col("t")).alias("key")).collect()
    for r in rows:
        assert r.lines == r.t.splitlines() and r.bare == r.t.strip() and r.key == re.sub(r"\s+", "", r.t).lower()
