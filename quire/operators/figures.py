"""Figures by page coordinates: detection, audit, fixes, ledger and insertion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import anchor_key, strip

PAGE = ["doc_id", "page_no"]
# Captions, words that open a sentence about a figure, footnotes, kinds and their spellings.
CAPTION = r"(?i)^\s*(Table|Scheme|Figure|Fig\.?|Chart|Eq\.?|表|圖|式)\s*([0-9]{1,3})\s*[.、:：]?\s*(.*)"
CITES = "^(中|所|如|為|是|則|與|和|及|的|之|顯示|可知|可以|說明|指出|列出|整理)"
FOOTNOTE = r"(?i)^\s*[a-zA-Zᵃ-ᵒ]?\s*\d*\s*(equiv|eq\b|mmol|條件|reaction|isolated|yield|determined|GC|NMR)"
KINDS = {"表": "table", "圖": "figure", "式": "scheme", "fig": "figure", "fig.": "figure"}
SPELLINGS = {"table": ["table", "表"], "scheme": ["scheme", "式"], "figure": ["figure", "fig", "圖"]}
BODY_CHARS, GAP, DEFAULT_LINE = 28, 2.2, 13.0


def caption(text: Column) -> Column:
    """Whether a block's first line is a caption and not a sentence that cites one."""
    first = strip(F.split_part(strip(text), F.lit("\n"), F.lit(1)))
    rest = F.trim(F.regexp_extract(first, CAPTION, 3))
    return first.rlike(CAPTION) & (F.length(first) < 120) & ~rest.rlike(CITES) & ~F.substring(rest, 1, 24).rlike("[，。；]")


def table_row(text: Column) -> Column:
    """Whether a block is a row of a table: an entry number, a result mark, or a short phrase without a sentence mark."""
    t = strip(text)
    short = F.length(t) < 110
    return (t != "") & ((t.rlike(r"^\d{1,2}[\s.)]") & short) | (t.rlike(r"N\.?D\.?|n\.?d\.?|trace|Trace|<\s*\d|\d\s*%") & short) | ((F.length(t) < 46) & ~t.rlike("[，。；、]")))


def footnote(text: Column) -> Column:
    return text.rlike(FOOTNOTE) & (F.length(text) < 120)


def kind_of(text: Column) -> Column:
    raw = F.lower(F.regexp_extract(text, CAPTION, 1))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[raw], raw)


def figure_id(text: Column, page: Column) -> Column:
    return F.format_string("%s-%02d_p%d", kind_of(text), F.regexp_extract(text, CAPTION, 2).cast("int"), page)


def upper_median(values: Column) -> Column:
    """Element n div 2 of the sorted values; null if there are none."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def line_height(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_no, line_h): the upper median height of blocks lower than 40 points."""
    h = F.col("y1") - F.col("y0")
    return blocks.groupBy(*PAGE).agg(F.coalesce(upper_median(F.collect_list(F.when(h < 40, h))), F.lit(DEFAULT_LINE)).alias("line_h"))


def captions(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Captions of each page with their neighbours: cap_no, y0, y1, text, next_y (or page height), floor (bottom of the
    caption before, or 0)."""
    order = Window.partitionBy(*PAGE).orderBy("y0", "block_no")
    found = blocks.where((strip(F.col("text")) != "") & caption(F.col("text"))).join(pages.select(*PAGE, "height"), PAGE)
    first = strip(F.split_part(strip(F.col("text")), F.lit("\n"), F.lit(1)))
    return found.select(*PAGE, F.row_number().over(order).alias("cap_no"), "y0", "y1", first.alias("text"), F.coalesce(F.lead("y0").over(order), F.col("height")).alias("next_y"), F.coalesce(F.lag("y1").over(order), F.lit(0.0)).alias("floor"), "height")


def extents(caps: DataFrame, blocks: DataFrame, images: DataFrame) -> DataFrame:
    """caps with y_start, y_end, height_pt and title_only of their figures.

    A figure stands above its caption if a wide gap is there and body text follows below. Otherwise it reaches down from
    its caption over blocks that are no body text, takes in images that it touches, and, if it is still hardly higher than
    a line, the nearest image. The walk is one aggregate over the page's blocks with the state (lower edge, stopped).
    """
    plain = strip(F.regexp_replace("text", "\n", " "))
    rows = blocks.where(strip(F.col("text")) != "").select(*PAGE, "y0", "y1", plain.alias("t"))
    rows = rows.withColumn("row", table_row(F.col("t"))).withColumn("note", footnote(F.col("t"))).withColumn("number", F.col("t").rlike(r"^\d{1,3}$"))
    page = rows.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("y0", "y1", "t", "row", "note", "number"))).alias("b"))
    pics = images.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("y0", "y1"))).alias("p"))
    c = caps.join(page, PAGE).join(line_height(blocks), PAGE).join(pics, PAGE, "left")
    c = c.withColumn("p", F.filter(F.coalesce("p", F.array().cast("array<struct<y0:double,y1:double>>")), lambda i: i["y1"] - i["y0"] > F.col("line_h")))
    c = c.withColumn("above", F.coalesce(F.array_max(F.transform(F.filter("b", lambda x: x["y1"] <= F.col("y0") - 1), lambda x: x["y1"])), F.lit(0.0)))
    below = F.filter("b", lambda x: (x["y0"] > F.col("y1") + 1) & ~x["number"])
    c = c.withColumn("follow", F.get(below, F.lit(0)))
    body_below = F.col("follow").isNotNull() & (F.length("follow.t") >= BODY_CHARS) & ~F.col("follow.row")
    c = c.withColumn("is_above", F.coalesce((F.col("y0") - F.col("above") > 4 * F.col("line_h")) & (F.col("above") > F.col("line_h")) & body_below, F.lit(False)))

    def step(s: Column, x: Column) -> Column:
        body = (F.length(x["t"]) >= BODY_CHARS) & (x["y0"] - s["e"] < F.col("line_h") * GAP) & ~x["row"] & ~x["note"]
        ends = s["stop"] | (x["y0"] >= F.col("next_y")) | (~x["number"] & body)
        return F.struct(F.when(ends | x["number"], s["e"]).otherwise(F.greatest(s["e"], x["y1"])).alias("e"), ends.alias("stop"))

    walk = F.aggregate(F.filter("b", lambda x: x["y0"] > F.col("y0")), F.struct(F.col("y1").alias("e"), F.lit(False).alias("stop")), step)["e"]
    c = c.withColumn("s0", F.col("y0")).withColumn("e0", walk)
    touch = F.filter("p", lambda i: (i["y0"] < F.col("next_y")) & (i["y1"] > F.col("y0") - 2 * F.col("line_h")))
    c = c.withColumn("s1", F.least("s0", F.coalesce(F.array_min(F.transform(touch, lambda i: i["y0"])), F.col("s0")))).withColumn("e1", F.greatest("e0", F.coalesce(F.array_max(F.transform(touch, lambda i: i["y1"])), F.col("e0"))))
    own = F.filter("p", lambda i: ~((F.col("next_y") < F.col("height")) & (F.abs((i["y0"] + i["y1"]) / 2 - F.col("next_y")) < F.abs((i["y0"] + i["y1"]) / 2 - F.col("y0")))))
    c = c.withColumn("own", own)
    under = F.filter("own", lambda i: (i["y0"] - F.col("y1") >= 0) & (i["y0"] - F.col("y1") < 8 * F.col("line_h")) & (i["y0"] < F.col("next_y")))
    over = F.filter("own", lambda i: ~((i["y0"] - F.col("y1") >= 0) & (i["y0"] - F.col("y1") < 8 * F.col("line_h")) & (i["y0"] < F.col("next_y"))) & (F.col("y0") - i["y1"] >= 0) & (F.col("y0") - i["y1"] < 10 * F.col("line_h")))
    flat = F.col("e1") - F.col("s1") < GAP * F.col("line_h")
    start = F.when(flat, F.least("s1", F.coalesce(F.array_min(F.transform(over, lambda i: F.greatest(i["y0"], F.col("floor") + 1))), F.col("s1")))).otherwise(F.col("s1"))
    end = F.when(flat, F.greatest("e1", F.coalesce(F.array_max(F.transform(under, lambda i: i["y1"])), F.col("e1")))).otherwise(F.col("e1"))
    end = F.least(end, F.col("next_y") - 2, F.col("height"))
    c = c.withColumn("y_start", F.when(F.col("is_above"), F.greatest(F.col("above") + 2, F.col("floor") + 2)).otherwise(start))
    c = c.withColumn("y_end", F.when(F.col("is_above"), F.col("y1") + F.col("line_h") * 0.5).otherwise(end)).where("is_above OR y_end > y_start")
    high = F.col("y_end") - F.col("y_start")
    alone = ~F.col("is_above") & (high < GAP * F.col("line_h")) & ((F.col("y_end") / F.col("height") > 0.82) | F.col("follow").isNull())
    return c.select(*caps.columns, "y_start", "y_end", F.round(high, 1).alias("height_pt"), F.coalesce(alone, F.lit(False)).alias("title_only"))


def figure_map(found: DataFrame) -> DataFrame:
    """Figures as they are exchanged: id, page, ratios of the page height, caption, height and title_only."""
    return found.select("doc_id", figure_id(F.col("text"), F.col("page_no")).alias("id"), F.col("page_no").alias("page"), F.round(F.col("y_start") / F.col("height"), 4).alias("y_start"), F.round(F.col("y_end") / F.col("height"), 4).alias("y_end"), F.col("text").alias("caption"), "height_pt", "title_only")


def caption_anchors(figures: DataFrame, lines: DataFrame) -> DataFrame:
    """figures (doc_id, id, caption) with anchor_text: the first heading line, else the first line, that holds the caption's
    kind and number, the number not being part of a longer one; empty if there is none. One equi-join on kind and number."""
    alternatives = "|".join(s for own in SPELLINGS.values() for s in own)
    hits = F.explode(F.regexp_extract_all(anchor_key(F.col("line")), F.lit(f"(?:{alternatives}|chart|eq)[0-9]+"), F.lit(0)))
    canon = {s: k for k, own in SPELLINGS.items() for s in own}
    names = F.create_map(*[F.lit(x) for kv in canon.items() for x in kv])

    def parts(c: Column) -> Column:
        kind = F.regexp_extract(c, r"^(\D+)", 1)
        return F.concat_ws(":", F.coalesce(names[kind], kind), F.regexp_extract(c, r"([0-9]+)$", 1))

    marks = lines.select("doc_id", "ln", "line", hits.alias("hit")).select("doc_id", "ln", "line", parts(F.col("hit")).alias("mark"))
    first = marks.groupBy("doc_id", "mark").agg(F.min_by("line", F.struct(~F.ltrim("line").startswith("#"), "ln")).alias("anchor_text"))
    mark = F.concat_ws(":", kind_of(F.col("caption")), F.regexp_extract("caption", CAPTION, 2))
    return figures.withColumn("mark", mark).join(first, ["doc_id", "mark"], "left").withColumn("anchor_text", F.coalesce("anchor_text", F.lit(""))).drop("mark")


def anchor_lines(figures: DataFrame, lines: DataFrame, least: int = 6) -> DataFrame:
    """figures (doc_id, id, anchor) with line_no: the first line equal to the anchor, else equal by key, else one of which
    either key contains the other (keys of `least` characters or more); -1 if none."""
    keyed = lines.select("doc_id", "ln", strip(F.col("line")).alias("bare"), anchor_key(F.col("line")).alias("lk"))
    f = figures.select("doc_id", "id", strip(F.col("anchor")).alias("a"), anchor_key(F.col("anchor")).alias("ak"))
    exact = f.join(keyed, (f["doc_id"] == keyed["doc_id"]) & (f["a"] == keyed["bare"])).select(f["doc_id"], "id", F.lit(0).alias("tier"), "ln")
    equal = f.join(keyed, (f["doc_id"] == keyed["doc_id"]) & (f["ak"] == keyed["lk"]) & (F.col("ak") != "")).select(f["doc_id"], "id", F.lit(1).alias("tier"), "ln")
    sure = exact.unionAll(equal).groupBy("doc_id", "id").agg(F.min_by("ln", F.struct("tier", "ln")).alias("line_no"))
    open_ = f.where(F.length("ak") >= least).join(sure, ["doc_id", "id"], "left_anti")
    held = F.contains(F.col("lk"), F.col("ak")) | F.contains(F.col("ak"), F.col("lk"))
    loose = open_.join(keyed.where(F.length("lk") >= least).select(F.col("doc_id").alias("d"), "ln", "lk"), (F.col("doc_id") == F.col("d")) & held)
    best = sure.unionAll(loose.groupBy("doc_id", "id").agg(F.min("ln").alias("line_no")))
    return figures.join(best, ["doc_id", "id"], "left").withColumn("line_no", F.coalesce("line_no", F.lit(-1)))


def ranked_ledger(statuses: DataFrame) -> DataFrame:
    """(id, status, rank) of a ledger: bad ones first, then pending, fixed and ok ones, by id within each."""
    # The order in which states are shown.
    rank = F.array_position(F.array(*[F.lit(s) for s in ("bad", "pending", "fixed", "ok")]), F.col("status")) - 1
    return statuses.withColumn("rank", rank.cast("int"))


def overlaps(figures: DataFrame) -> DataFrame:
    """(doc_id, page, id, other): figures of one page whose ranges overlap, the other with the smaller id."""
    other = figures.select("doc_id", "page", F.col("id").alias("other"), F.col("y_start").alias("os"), F.col("y_end").alias("oe"))
    return figures.join(other, ["doc_id", "page"]).where("other < id AND NOT (y_end <= os OR y_start >= oe)").select("doc_id", "page", "id", "other")


def contained_text(figures: DataFrame, blocks: DataFrame, slack: float = 2.0) -> DataFrame:
    """(doc_id, id, text): the texts of blocks inside each figure's range (points y0, y1), from top to bottom."""
    b = blocks.select("doc_id", F.col("page_no").alias("page"), F.col("y0").alias("by0"), F.col("y1").alias("by1"), "block_no", "text")
    inside = figures.select("doc_id", "page", "id", "y0", "y1").join(b, ["doc_id", "page"]).where(f"by0 >= y0 - {slack} AND by1 <= y1 + {slack}")
    pairs = F.array_sort(F.collect_list(F.struct("by0", "block_no", "text")))
    return inside.groupBy("doc_id", "id").agg(F.array_join(F.transform(pairs, lambda p: p["text"]), "\n").alias("text"))


def image_cover(figures: DataFrame, images: DataFrame) -> DataFrame:
    """figures (y0, y1 points) with overlap (largest with an image) and image_table (over 60 points and 35 % of the height)."""
    i = images.select("doc_id", F.col("page_no").alias("page"), F.col("y0").alias("iy0"), F.col("y1").alias("iy1"))
    found = figures.join(i, ["doc_id", "page"]).groupBy("doc_id", "id").agg(F.max(F.least("y1", "iy1") - F.greatest("y0", "iy0")).alias("overlap"))
    out = figures.join(found, ["doc_id", "id"], "left").withColumn("overlap", F.greatest(F.coalesce("overlap", F.lit(0.0)), F.lit(0.0)))
    return out.withColumn("image_table", F.col("overlap") > F.greatest(F.lit(60.0), 0.35 * (F.col("y1") - F.col("y0"))))


def next_block(figures: DataFrame, blocks: DataFrame) -> DataFrame:
    """figures with next_y: the top of the first block below the lower edge of each."""
    b = blocks.select("doc_id", F.col("page_no").alias("page"), F.col("y0").alias("by0"))
    found = figures.join(b, ["doc_id", "page"]).where("by0 > y1").groupBy("doc_id", "id").agg(F.min("by0").alias("next_y"))
    return figures.join(found, ["doc_id", "id"], "left")


def image_claims(caps: DataFrame, images: DataFrame) -> DataFrame:
    """(doc_id, page_no, img_no, cap_no): the caption each image belongs to: the nearest by the distance of its middle."""
    mid = (F.col("i.y0") + F.col("i.y1")) / 2
    pairs = images.alias("i").join(caps.alias("c"), PAGE).select(*PAGE, "img_no", "cap_no", F.abs(mid - F.col("c.y0")).alias("d"))
    return pairs.groupBy(*PAGE, "img_no").agg(F.min_by("cap_no", F.struct("d", "cap_no")).alias("cap_no"))


def continuations(figures: DataFrame, pages: DataFrame) -> DataFrame:
    """Title-only figures with the page after (next_page) and n_more: how many of the up to three pages behind it follow
    each other as sparse pages. pages: doc_id, page_no, sparse."""
    window = Window.partitionBy("doc_id").orderBy("page_no")
    ahead = [F.coalesce(F.lead("sparse", k).over(window), F.lit(False)) for k in (1, 2, 3)]
    run = F.when(~ahead[0], 0).when(~ahead[1], 1).when(~ahead[2], 2).otherwise(3)
    following = pages.select("doc_id", F.col("page_no").alias("next_page"), run.alias("n_more"))
    return figures.where("title_only").withColumn("next_page", F.col("page") + 1).join(following, ["doc_id", "next_page"])


def audit(figures: DataFrame) -> DataFrame:
    """(doc_id, id, severity, code): findings on ratios y_start, y_end, height_pt, anchor_text and continued. An inverted
    range is the only finding of its figure."""
    s, e = F.col("y_start"), F.col("y_end")

    def finding(test: Column, severity: str, code: str) -> Column:
        return F.when(test, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code")))

    rest = F.array_compact(F.array(
        finding((s < 0) | (e > 1.001), "issue", "out_of_bounds"),
        finding((F.col("height_pt") < 40) & ~F.col("continued"), "issue", "too_low"),
        finding(e - s > 0.95, "warning", "whole_page"),
        finding(F.coalesce(F.col("anchor_text"), F.lit("")) == "", "warning", "no_anchor"),
    ))
    every = F.when(e <= s, F.array(F.struct(F.lit("issue").alias("severity"), F.lit("inverted").alias("code")))).otherwise(rest)
    return figures.select("doc_id", "id", F.explode(every).alias("f")).select("doc_id", "id", "f.severity", "f.code")


def audit_tables(figures: DataFrame) -> DataFrame:
    """(doc_id, id, code) for table figures with text (as contained_text gives it), overlap and next_y."""
    rows = F.regexp_count("text", F.lit(r"(?m)^\s*\d{1,2}[\s.)]"))
    high = F.col("y1") - F.col("y0")
    codes = F.array_compact(F.array(
        F.when(F.col("image_table") & (F.col("overlap") < 0.5 * high), F.lit("image_cut")),
        F.when(~F.col("image_table") & (rows == 0), F.lit("no_rows")),
        F.when(~F.col("image_table") & (rows == 1), F.lit("one_row")),
        F.when(~F.col("image_table") & ~F.coalesce(F.col("text").rlike("(?im)" + FOOTNOTE.removeprefix("(?i)")), F.lit(False)), F.lit("no_footnote")),
        F.when(F.col("next_y") - F.col("y1") < 6, F.lit("tight_below")),
    ))
    return figures.where(F.col("id").startswith("table")).select("doc_id", "id", F.explode(codes).alias("code"))


def must_view(figures: DataFrame, findings: DataFrame) -> DataFrame:
    """(doc_id, id, reason): figures with a finding, and the lowest and the highest figure of each document."""
    flagged = figures.join(findings.select("doc_id", "id").distinct(), ["doc_id", "id"], "left_semi").select("doc_id", "id", F.lit("finding").alias("reason"))
    ends = figures.groupBy("doc_id").agg(F.min_by("id", F.struct("height_pt", "id")).alias("lo"), F.max_by("id", F.struct("height_pt", "id")).alias("hi"))
    return flagged.unionAll(ends.select("doc_id", F.col("lo").alias("id"), F.lit("lowest"))).unionAll(ends.select("doc_id", F.col("hi").alias("id"), F.lit("highest")))


def crop_boxes(figures: DataFrame, pad: float = 0.01) -> DataFrame:
    """(doc_id, id, top, bottom, error): padded and clamped ranges in points; error names what makes a crop impossible."""
    top = F.greatest(F.lit(0.0), F.col("y_start") - pad) * F.col("page_height")
    bottom = F.least(F.lit(1.0), F.col("y_end") + pad) * F.col("page_height")
    error = F.when(~F.col("page").between(F.lit(1), F.col("n_pages")), F.lit("page")).when(bottom <= top, F.lit("range"))
    return figures.select("doc_id", "id", F.round(top, 2).alias("top"), F.round(bottom, 2).alias("bottom"), error.alias("error"))


def crop_files(figures: DataFrame, files: DataFrame, least: int = 4096) -> DataFrame:
    """(doc_id, id, problem): figures whose crop file is missing or tiny. files: name, length."""
    want = figures.withColumn("name", F.concat("id", F.lit(".png"))).join(files, "name", "left")
    return want.withColumn("problem", F.when(F.col("length").isNull(), F.lit("missing")).when(F.col("length") < least, F.lit("tiny"))).where("problem IS NOT NULL").select("doc_id", "id", "problem")


def apply_fixes(figures: DataFrame, fixes: DataFrame) -> DataFrame:
    """figures after fixes (doc_id, id, y_start, y_end, dropped): new ratios are floored at 0, capped at 1 and rounded to
    four decimals; an inverted result keeps the old range and says so; dropped figures go."""
    f = fixes.select("doc_id", "id", F.col("y_start").alias("ns"), F.col("y_end").alias("ne"), "dropped")
    out = figures.join(f, ["doc_id", "id"], "left").where("NOT coalesce(dropped, false)")
    s = F.round(F.greatest(F.coalesce("ns", "y_start"), F.lit(0.0)), 4)
    e = F.round(F.least(F.coalesce("ne", "y_end"), F.lit(1.0)), 4)
    out = out.withColumn("s", s).withColumn("e", e).withColumn("rejected", F.col("e") <= F.col("s"))
    out = out.withColumn("y_start", F.when(F.col("rejected"), F.col("y_start")).otherwise(F.col("s"))).withColumn("y_end", F.when(F.col("rejected"), F.col("y_end")).otherwise(F.col("e")))
    return out.withColumn("height_pt", F.round((F.col("y_end") - F.col("y_start")) * F.col("page_height"), 1)).drop("ns", "ne", "dropped", "s", "e")


def ledger(items: DataFrame, marks: DataFrame) -> DataFrame:
    """(id, status): the latest mark of each item (id, ts, status), else pending."""
    last = marks.groupBy("id").agg(F.max_by("status", F.struct("ts", "status")).alias("status"))
    return items.select("id").join(last, "id", "left").withColumn("status", F.coalesce("status", F.lit("pending")))


def gate(statuses: DataFrame) -> DataFrame:
    """One row: counts by status and the verdict; bad ones are reported before pending ones."""
    counts = statuses.agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("bad", "pending", "fixed", "ok")])
    return counts.withColumn("verdict", F.when(F.col("n_bad") > 0, F.lit("bad")).when(F.col("n_pending") > 0, F.lit("pending")).otherwise(F.lit("pass")))


def reference(fig_id: Column, caption_: Column, folder: str, style: str = "markdown") -> Column:
    return F.format_string(f"![[{folder}/%s.png]]", fig_id) if style == "obsidian" else F.format_string(f"![%s](./{folder}/%s.png)", caption_, fig_id)


def inserted(lines: DataFrame, refs: DataFrame) -> DataFrame:
    """(doc_id, text): lines (ln, line) with references (at, k, ref) before line `at`, each between empty lines; those at
    one place come out in reverse order of k."""
    own = lines.select("doc_id", F.col("ln").alias("at"), F.lit(1).alias("kind"), F.lit(0).alias("k"), F.lit(0).alias("j"), "line")
    three = refs.select("doc_id", "at", F.lit(0).alias("kind"), (-F.col("k")).alias("k"), F.posexplode(F.array(F.lit(""), F.col("ref"), F.lit(""))).alias("j", "line"))
    pairs = F.array_sort(F.collect_list(F.struct("at", "kind", "k", "j", "line")))
    return own.unionByName(three).groupBy("doc_id").agg(F.array_join(F.transform(pairs, lambda p: p["line"]), "\n").alias("text"))


# image statistics


def pixel_statistics(pixels: Column) -> Column:
    """Struct of mean, population deviation and number of levels of an array of gray values."""
    n = F.nullif(F.size(pixels), F.lit(0))
    mean = F.aggregate(pixels, F.lit(0.0), lambda s, x: s + x) / n
    square = F.aggregate(pixels, F.lit(0.0), lambda s, x: s + x.cast("double") * x) / n
    return F.struct(mean.alias("mean"), F.when(n > 0, F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))).alias("std"), F.size(F.array_distinct(pixels)).alias("levels"))


def blank_verdict(mean: Column, std: Column, levels: Column) -> tuple[Column, Column]:
    """(reasons, verdict): bad for a flat, black or two-tone image; suspect if nearly flat; else ok."""
    reasons = F.array_compact(F.array(F.when(std < 8, F.lit("flat")), F.when((mean < 25) & (std < 20), F.lit("black")), F.when(levels < 6, F.lit("few_levels"))))
    return reasons, F.when(F.size(reasons) > 0, F.lit("bad")).when(std < 16, F.lit("suspect")).otherwise(F.lit("ok"))


def batch_alarm(verdicts: DataFrame) -> DataFrame:
    """Counts by verdict and whether more than 30 % are bad."""
    out = verdicts.agg(*[F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("bad", "suspect", "ok")], F.count("*").alias("n"))
    return out.withColumn("alarm", F.coalesce(F.col("n_bad") / F.nullif("n", F.lit(0)) > 0.3, F.lit(False)))
