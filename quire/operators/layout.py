"""Page layout: fonts, headings, repeated zones, tables, captions and paragraphs from spans, blocks, words and rectangles.

All joins carry (doc_id, page_no) or doc_id as an equi key with the geometric condition as a residual.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import page_number, strip
from quire.operators.tables import valid_table

PAGE = ["doc_id", "page_no"]
TABLE_WORDS = ("Table", "TABLE")  # fixed values: words that a table's caption starts with
DEFAULT_BODY = 10.0
PRESENTATION_BODY = 18.0
# What bold lines of body size must look like to be headings, and what captions start with.
HEADING_TEXT = r"^(?:\d+\.)+\s|(?i)^(?:Abstract|Introduction|Conclusion|Discussion|Results|Experimental|Methods|References|Acknowledgment|Supporting\s+Information)|(?i)^(?:Scheme|Figure|Table)\s+\d+"
CAPTION = r"(?i)^(?:Figure|Fig\.|Scheme|Table|Chart)\s*\d+"


def body_font(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, body_size, presentation) for every document of docs: the size (one decimal) with most stripped characters,
    the first seen among equals, 10.0 without text. spans: doc_id, ord, text, size."""
    weights = spans.groupBy("doc_id", F.round("size", 1).alias("size")).agg(F.sum(F.length(strip(F.col("text")))).alias("w"), F.min("ord").alias("first"))
    best = weights.where("w > 0").groupBy("doc_id").agg(F.max_by("size", F.struct("w", -F.col("first"))).alias("body_size"))
    out = docs.select("doc_id").distinct().join(best, "doc_id", "left").withColumn("body_size", F.coalesce("body_size", F.lit(DEFAULT_BODY)))
    return out.withColumn("presentation", F.col("body_size") >= PRESENTATION_BODY)


def line_sizes(spans: DataFrame) -> DataFrame:
    """(doc_id, page_no, block_no, line_no, x0, y0, text, size, bold) per line: the size weighted by the length of spans with text."""
    full = strip(F.col("text")) != ""
    n = F.when(full, F.length("text")).otherwise(0)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_no", "text"))), lambda s: s["text"]), "")
    return spans.groupBy(*PAGE, "block_no", "line_no").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), strip(text).alias("text"),
        F.round(F.sum(F.when(full, F.col("size") * n).otherwise(0.0)) / F.greatest(F.sum(n), F.lit(1)), 1).alias("size"),
        F.coalesce(F.bool_or(full & F.lower("font").contains("bold")), F.lit(False)).alias("bold"),
    )


def heading_levels(lines: DataFrame, body: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """lines with `level` (0: none) from the distance of their size to the body size."""
    step = F.when(F.col("presentation"), 5.0).otherwise(1.5)
    diff = F.round(F.col("size") - F.col("body_size"), 6)
    level = (
        F.when((F.col("text") == "") | (F.length("text") <= 5), 0)
        .when(diff >= 2 * step, 1)
        .when(diff >= step, 2)
        .when((diff >= tolerance) & F.col("bold"), 3)
        .when(F.col("bold") & (diff >= 0) & F.col("text").rlike(HEADING_TEXT), 3)
        .otherwise(0)
    )
    return lines.join(body, "doc_id").withColumn("level", level).drop("body_size", "presentation")


def level_lookup(lines: DataFrame, levels: DataFrame, scope: str = "doc") -> DataFrame:
    """lines with the level of the heading at the same rounded place. In scope `doc` a place counts on all pages and the
    last page wins; in scope `page` it counts on its own page."""
    key = ["doc_id", "kx", "ky"] + (["page_no"] if scope == "page" else [])
    at = [F.round("x0", 1).alias("kx"), F.round("y0", 1).alias("ky")]
    found = levels.where("level > 0").select(*PAGE, "block_no", "line_no", *at, F.col("level").alias("known")).groupBy(*key).agg(F.max_by("known", F.struct("page_no", "block_no", "line_no")).alias("known"))
    out = lines.select("*", *at).join(found, key, "left")
    return out.withColumn("level", F.coalesce("known", F.lit(0))).drop("kx", "ky", "known")


def repeated_zones(blocks: DataFrame, pages: DataFrame, top: float = 0.08, bottom: float = 0.92) -> DataFrame:
    """(doc_id, zone, text) of block texts in the top or bottom zone (of the first page's height) of at least half of the
    pages of a document with three pages or more."""
    size = pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.min_by("height", "page_no").alias("height"))
    here = blocks.join(size, "doc_id").withColumn("text", strip(F.col("text"))).where("n_pages >= 3 AND text <> ''")
    zone = F.explode(F.array_compact(F.array(F.when(F.col("y0") < F.col("height") * top, F.lit("header")), F.when(F.col("y1") > F.col("height") * bottom, F.lit("footer")))))
    found = here.select(*PAGE, "n_pages", zone.alias("zone"), "text").distinct().groupBy("doc_id", "zone", "text", "n_pages").agg(F.count("*").alias("n"))
    return found.where("n >= 0.5 * n_pages").select("doc_id", "zone", "text")


def body_lines(lines: DataFrame, repeated: DataFrame) -> DataFrame:
    """Lines that are neither empty, nor page numbers, nor repeated zone texts."""
    known = repeated.select("doc_id", "text").distinct()
    return lines.where((F.col("text") != "") & ~page_number(F.col("text"))).join(known, ["doc_id", "text"], "left_anti")


def outside_tables(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Blocks (x0, y0, x1, y1) that overlap no table (tx0, ty0, tx1, ty1) of their page; touching is no overlap."""
    hit = (F.col("b.y0") < F.col("t.ty1")) & (F.col("b.y1") > F.col("t.ty0")) & (F.col("b.x0") < F.col("t.tx1")) & (F.col("b.x1") > F.col("t.tx0"))
    return blocks.alias("b").join(tables.alias("t"), (F.col("b.doc_id") == F.col("t.doc_id")) & (F.col("b.page_no") == F.col("t.page_no")) & hit, "left_anti")


def image_captions(images: DataFrame, blocks: DataFrame, depth: float = 50.0) -> DataFrame:
    """images (img_no, y1, height of the page) with `caption`: the first caption block that starts within `depth` below."""
    near = images.select(*PAGE, "img_no", F.col("y1").alias("edge"), F.least(F.col("y1") + depth, F.col("page_height")).alias("low"))
    texts = blocks.select(*PAGE, "block_no", F.col("y0").alias("top"), strip(F.col("text")).alias("t")).where(F.col("t").rlike(CAPTION))
    found = near.join(texts, PAGE).where("top BETWEEN edge AND low").groupBy(*PAGE, "img_no").agg(F.min_by("t", "block_no").alias("caption"))
    alt = F.coalesce(F.substring("caption", 1, 200), F.format_string("Image p%d", F.col("page_no") + 1))
    return images.join(found, [*PAGE, "img_no"], "left").withColumn("caption", alt)


def kept_images(images: DataFrame, width: Column, height: Column) -> DataFrame:
    """Images of at least the given size with `file_no`, their place among all images of the page before the filter."""
    order = Window.partitionBy(*PAGE).orderBy("img_no")
    return images.withColumn("file_no", F.row_number().over(order)).where((F.col("width") >= width) & (F.col("height") >= height))


def paragraphs(lines: DataFrame, key: list[str], order: str, heading: Column, text: str = "text") -> DataFrame:
    """(key, part, heading, text): neighbouring lines that are no headings joined by spaces, each heading on its own."""
    window = Window.partitionBy(*key).orderBy(order)
    breaks = heading | F.coalesce(F.lag(heading).over(window), F.lit(False))
    rows = lines.withColumn("h", heading).withColumn("part", F.sum(breaks.cast("int")).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return rows.groupBy(*key, "part").agg(F.bool_or("h").alias("heading"), F.array_join(F.transform(pairs, lambda p: p["t"]), " ").alias("text"))


def ruling_lines(rects: DataFrame, width: float = 100, height: float = 5, top: float = 0.15, bottom: float = 0.9) -> DataFrame:
    """Rectangles that are horizontal rules inside the table zone of their page."""
    return rects.where((F.col("x1") - F.col("x0") >= width) & (F.col("bottom") - F.col("top") < height) & F.col("top").between(F.col("page_height") * top, F.col("page_height") * bottom))


def chained(rects: DataFrame, key: list[str], order: list[str], near: float = 30.0) -> DataFrame:
    """rects with `grp`: a new group starts where either side moves by `near` or more from the rectangle before."""
    window = Window.partitionBy(*key).orderBy(*order)
    far = (F.abs(F.col("x0") - F.lag("x0").over(window)) >= near) | (F.abs(F.col("x1") - F.lag("x1").over(window)) >= near)
    return rects.withColumn("grp", F.sum(F.coalesce(far, F.lit(False)).cast("int")).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def group_extent(groups: DataFrame, key: list[str]) -> DataFrame:
    return groups.groupBy(*key, "grp").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.count("*").alias("n"))


def caption_above(groups: DataFrame, words: DataFrame, wide: float = 0.4, slack: float = 30.0) -> DataFrame:
    """groups with (cap_top, cap_x0) of the first caption word above: on the whole page for wide groups, else within slack."""
    marks = words.where(F.col("text").isin(*TABLE_WORDS)).select(*PAGE, F.col("x0").alias("wx"), F.col("top").alias("wtop"))
    broad = F.col("x1") - F.col("x0") > F.col("page_width") * wide
    near = broad | F.col("wx").between(F.col("x0") - slack, F.col("x1") + slack)
    found = groups.join(marks, PAGE).where((F.col("wtop") < F.col("top")) & near).groupBy(*PAGE, "grp").agg(F.min("wtop").alias("cap_top"), F.min_by("wx", F.struct("wtop", "wx")).alias("cap_x0"))
    return groups.join(found, [*PAGE, "grp"], "left")


def crop_zones(groups: DataFrame, wide: float = 0.4, margin: float = 5.0, below: float = 50.0) -> DataFrame:
    """groups (as caption_above gives them, with page_width and page_height) that have a caption, with the box to cut: zx0,
    ztop, zx1, zbottom. A wide group keeps to the half of the page in which its caption stands."""
    g = groups.where("cap_top IS NOT NULL")
    width, broad = F.col("page_width"), F.col("x1") - F.col("x0") > F.col("page_width") * wide
    left_half = broad & (F.col("cap_x0") < width / 2)
    x0 = F.greatest(F.lit(0.0), F.when(left_half, F.col("cap_x0") - margin).otherwise(F.col("x0") - margin))
    x1 = F.least(F.when(left_half, width / 2 + 10).otherwise(width), F.col("x1") + margin)
    return g.withColumns({"zx0": x0, "ztop": F.greatest(F.lit(0.0), F.col("cap_top") - margin), "zx1": x1, "zbottom": F.least(F.col("page_height"), F.col("bottom") + below)})


def entry_zones(entries: DataFrame, words: DataFrame, slack: float = 20.0, margin: float = 5.0, reach: float = 300.0, pad: float = 10.0) -> DataFrame:
    """entries (as entry_headers gives them, with page_width and page_height) under a caption word that starts no more than
    `slack` left of their left border, with the caption's top and the box to cut; entries without one go."""
    marks = words.where(F.col("text").isin(*TABLE_WORDS)).select(*PAGE, F.col("x0").alias("wx"), F.col("top").alias("wtop"))
    left, right = F.element_at("headers", 1)["x0"] - pad, F.element_at("headers", -1)["x1"] + pad
    e = entries.withColumns({"left": left, "right": right})
    found = e.join(marks, PAGE).where((F.col("wtop") < F.col("entry_top")) & (F.col("wx") >= F.col("left") - slack))
    cap = found.groupBy(*PAGE, "entry_top", "entry_x0").agg(F.min("wtop").alias("cap_top"))
    e = e.join(cap, [*PAGE, "entry_top", "entry_x0"])
    return e.withColumns({
        "zx0": F.greatest(F.lit(0.0), F.col("left") - margin), "ztop": F.greatest(F.lit(0.0), F.col("cap_top") - margin),
        "zx1": F.least(F.col("page_width"), F.col("right") + margin), "zbottom": F.least(F.col("page_height"), F.col("entry_top") + reach),
    }).drop("left", "right")


def zone_tables(zones: DataFrame, words: DataFrame, key: list[str], borders: Column | None = None, line: float = 3.0, gap: float = 8.0) -> DataFrame:
    """(key, rows): the words (text, x0, x1, top) of each zone as rows of cells.

    Words whose tops differ by less than `line` from the word above are one row. Columns lie between the given borders
    (array<double>), else between the gaps of at least `gap` that no word of the zone reaches into.
    """
    z = zones.withColumn("borders", borders) if borders is not None else zones.withColumn("borders", F.lit(None).cast("array<double>"))
    w = words.select(*PAGE, "text", F.col("x0").alias("wx0"), F.col("x1").alias("wx1"), F.col("top").alias("wtop"))
    inside = z.select(*PAGE, *[k for k in key if k not in PAGE], "borders", "zx0", "ztop", "zx1", "zbottom").join(w, PAGE)
    inside = inside.where("wx0 >= zx0 AND wx1 <= zx1 AND wtop >= ztop AND wtop <= zbottom")
    own = F.array_sort(F.collect_list(F.struct("wtop", "wx0", "wx1", "text")))
    zone = inside.groupBy(*key).agg(own.alias("w"), F.first("borders").alias("borders"))
    first = F.struct(F.lit(-1e9).alias("top"), F.lit(-1).alias("row"), F.array().cast("array<struct<row:int,wx0:double,wx1:double,text:string>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        row = F.when(x["wtop"] - s["top"] >= line, s["row"] + 1).otherwise(s["row"])
        return F.struct(x["wtop"].alias("top"), row.alias("row"), F.concat(s["out"], F.array(F.struct(row.alias("row"), x["wx0"].alias("wx0"), x["wx1"].alias("wx1"), x["text"].alias("text")))).alias("out"))

    numbered = F.array_sort(F.aggregate("w", first, step)["out"])
    spread = F.array_sort(F.transform("w", lambda x: F.struct(x["wx0"].alias("a"), x["wx1"].alias("b"))))
    start = F.struct(F.lit(float("-inf")).alias("b"), F.array().cast("array<double>").alias("cut"))
    gaps = F.aggregate(spread, start, lambda s, x: F.struct(F.greatest(s["b"], x["b"]).alias("b"), F.when(x["a"] - s["b"] >= gap, F.concat(s["cut"], F.array(x["a"]))).otherwise(s["cut"]).alias("cut")))["cut"]
    left = F.coalesce(F.slice("borders", 1, F.greatest(F.size("borders") - 1, F.lit(1))), gaps)
    middle = lambda x: (x["wx0"] + F.when(F.col("borders").isNull(), x["wx0"]).otherwise(x["wx1"])) / 2

    def placed(s: Column) -> Column:
        column = lambda x: F.greatest(F.lit(0), F.size(F.filter(s["left"], lambda e: e <= middle(x))) - 1)
        return F.struct(F.transform(s["n"], lambda x: F.struct(x["row"].alias("row"), column(x).alias("column"), x["text"].alias("text"))).alias("cells"), F.size(s["left"]).alias("width"))

    def laid_out(s: Column) -> Column:
        cell = lambda r, c: F.array_join(F.transform(F.filter(s["cells"], lambda x: (x["row"] == r) & (x["column"] == c)), lambda x: x["text"]), " ")
        last = F.element_at(s["cells"], -1)["row"]
        return F.transform(F.sequence(F.lit(0), last), lambda r: F.transform(F.sequence(F.lit(0), s["width"] - 1), lambda c: cell(r, c)))

    # each transform over one element binds its value, so nothing is worked out again for every cell
    rows = F.transform(F.transform(F.array(F.struct(numbered.alias("n"), left.alias("left"))), placed), laid_out)
    return zone.select(*key, F.get(rows, F.lit(0)).alias("rows"))


def table_cascade(given: DataFrame, rects: DataFrame, words: DataFrame, pages: DataFrame, top: float = 0.15) -> DataFrame:
    """(doc_id, page_no, tbl_no, rows) of each page by the first strategy that gives a valid table.

    given: tables that the parser found itself (doc_id, page_no, top, rows), below `top` of the page. Then zones of ruling
    rectangles (doc_id, page_no, x0, x1, top, bottom) under a caption, then columns under a header that begins with `entry`.
    words: doc_id, page_no, text, x0, x1, top. pages: doc_id, page_no, page_width, page_height.
    """
    own = given.join(pages, PAGE).where(F.col("top") >= F.col("page_height") * top).select(*PAGE, F.lit(1).alias("prio"), F.col("top").alias("at"), F.lit(0.0).alias("x"), "rows")
    ruled = chained(ruling_lines(rects.join(pages, PAGE)), PAGE, ["top", "x0"])
    groups = caption_above(group_extent(ruled, PAGE).join(pages, PAGE), words)
    second = zone_tables(crop_zones(groups), words, [*PAGE, "ztop", "zx0"]).select(*PAGE, F.lit(2), "ztop", "zx0", "rows")
    paged = words.join(pages, PAGE)
    entries = entry_zones(entry_headers(paged).join(pages, PAGE), words)
    third = zone_tables(entries, words, [*PAGE, "ztop", "zx0"], column_borders(F.col("headers"))).select(*PAGE, F.lit(3), "ztop", "zx0", "rows")
    found = own.unionAll(second).unionAll(third).where(valid_table(F.col("rows")))
    order = Window.partitionBy(*PAGE).orderBy("at", "x")
    return first_strategy(found).withColumn("tbl_no", F.row_number().over(order) - 1).select(*PAGE, "tbl_no", "rows")


def text_blocks(blocks: DataFrame) -> DataFrame:
    """Only blocks of text, where the table of blocks says what each is (type 0)."""
    return blocks.where("type = 0") if "type" in blocks.columns else blocks


def page_images(pages: DataFrame, folder: str = "images") -> DataFrame:
    """Parts (as page_text takes them) that show each page (doc_id, page_no) as a picture: images/pages/page_001.png, ..."""
    n = F.col("page_no") + 1
    return pages.select("doc_id", "page_no", F.lit(3).alias("kind"), F.lit(0).cast("long").alias("k"), F.format_string(f"\n![Page %d]({folder}/pages/page_%03d.png)\n", n, n).alias("line"))


def page_descriptions(described: DataFrame) -> DataFrame:
    """Parts with what was said of pages (doc_id, page_no, descr)."""
    line = F.format_string("<!-- Page %d VLM descriptions -->\n%s\n", F.col("page_no") + 1, F.col("descr"))
    return described.select("doc_id", "page_no", F.lit(4).alias("kind"), F.lit(0).cast("long").alias("k"), line.alias("line"))


def entry_headers(words: DataFrame, band: float = 5.0, least: int = 3, zone: float = 0.1) -> DataFrame:
    """(doc_id, page_no, entry_top, entry_x0, headers): words on the line of each `entry` word below the zone, from left to
    right, if there are at least three."""
    entry = words.where((F.lower("text") == "entry") & (F.col("top") >= F.col("page_height") * zone)).select(*PAGE, F.col("top").alias("entry_top"), F.col("x0").alias("entry_x0"))
    same = entry.join(words.select(*PAGE, "text", "x0", "x1", "top"), PAGE).where((F.abs(F.col("top") - F.col("entry_top")) < band) & (F.col("x0") >= F.col("entry_x0")))
    out = same.groupBy(*PAGE, "entry_top", "entry_x0").agg(F.array_sort(F.collect_list(F.struct("x0", "x1", "text"))).alias("headers"))
    return out.where(F.size("headers") >= least)


def column_borders(headers: Column, pad: float = 10.0) -> Column:
    """Borders between header words (arrays of x0, x1): midpoints of the gaps, and the outer sides with some room."""
    n = F.size(headers)
    mid = F.transform(F.sequence(F.lit(1), n - 1), lambda k: (F.element_at(headers, k)["x1"] + F.element_at(headers, k + 1)["x0"]) / 2)
    left, right = F.array(F.element_at(headers, 1)["x0"] - pad), F.array(F.element_at(headers, -1)["x1"] + pad)
    return F.concat(left, F.when(n > 1, mid).otherwise(F.array().cast("array<double>")), right)


def first_strategy(candidates: DataFrame) -> DataFrame:
    """Tables (doc_id, page_no, prio, ...) of the strategy with the least prio on each page."""
    best = F.min("prio").over(Window.partitionBy(*PAGE))
    return candidates.withColumn("best", best).where("prio = best").drop("best")


def page_text(parts: DataFrame) -> DataFrame:
    """(doc_id, markdown): lines (page_no, kind, k, line) in the order of pages, then text (0), tables (1), images (2), page
    image (3) and description (4), then k."""
    pairs = F.array_sort(F.collect_list(F.struct("page_no", "kind", "k", "line")))
    return parts.groupBy("doc_id").agg(F.array_join(F.transform(pairs, lambda p: p["line"]), "\n").alias("markdown"))
