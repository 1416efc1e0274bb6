"""Sections of long Markdown: splitting by heading level or pattern, file names, contents tables, front matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import file_name, rstrip, strip, token_estimate
from quire.operators.lines import check_pattern

# Named split patterns, headings that always split, the name and title of text before the first section.
SHORTCUTS = {"chinese": "^[一二三四五六七八九十百]+、", "numbered": r"^\d+\.\s", "chapter": r"^Chapter\s+\d+"}
ALWAYS = (r"^[一二三四五六七八九十百千]+[、．]", r"^\d+\.[\d.]* ", "(?i)^(Abstract|Introduction|Conclusion|References|附錄|摘要|目錄|圖目錄|表目錄|緒論|文獻回顧|結論|參考文獻)")
PREAMBLE_FILE, PREAMBLE_TITLE = "00-前言.md", "前言"
TOC_TITLE = "目錄"
TOC_HEAD = ("| # | 檔案 | 章節標題 | 行數 | 預估 tokens[a] |", "|---|------|---------|------|---------------|")
TOC_NOTE = "[a] tokens 預估以中文 1.5 字/token、英文 0.75 詞/token 粗估，僅供參考。"


def structural(title: Column, strict: bool = False) -> Column:
    """Whether a heading opens a section: numbered and known ones do; others unless strict, mathematical or too short."""
    known = F.lit(False)
    for pattern in ALWAYS:
        known = known | title.rlike(pattern)
    if strict:
        return known
    plain = F.length(F.regexp_replace(title, r"(?U)[^\w一-鿿]", "")) >= 5
    return known | (~title.rlike("[=±×]") & plain)


def heading_splits(level: int, strict: bool = False) -> tuple[Column, Column]:
    """(opens a section, title) of a column `line` for headings of exactly `level` marks."""
    pattern = rf"(?U)^#{{{level}}}\s+(.+?)\s*$"
    title = strip(F.regexp_extract(rstrip(F.col("line")), pattern, 1))
    return F.col("line").rlike(rf"(?U)^#{{{level}}}\s+\S") & structural(title, strict), title


def pattern_splits(pattern: str) -> tuple[Column, Column]:
    """(opens a section, title) for lines that a shortcut or regular expression finds; the whole line is the title."""
    line = rstrip(F.col("line"))
    return line.rlike(check_pattern(SHORTCUTS.get(pattern, pattern))), line


def sections(lines: DataFrame, splits: tuple[Column, Column], key: str = "doc_id") -> DataFrame:
    """(key, sec_no, title, lines): sections in order; sec_no 0 with a null title is text before the first one.

    One shuffle by document: the running count of openings and the grouping share it.
    """
    opens, title = splits
    order = Window.partitionBy(key).orderBy("ln").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.withColumn("opens", opens).withColumn("title", F.when(F.col("opens"), title)).withColumn("sec_no", F.sum(F.col("opens").cast("int")).over(order))
    body = F.array_sort(F.collect_list(F.struct("ln", "line")))
    return rows.groupBy(key, "sec_no").agg(F.max("title").alias("title"), F.transform(body, lambda p: p["line"]).alias("lines"))


def described(found: DataFrame, key: str = "doc_id", prefix: bool = True) -> DataFrame:
    """Sections with idx (titled ones from 1), n_lines, n_chars (line ends count), est_tokens, filename."""
    idx = F.sum(F.col("title").isNotNull().cast("int")).over(Window.partitionBy(key).orderBy("sec_no").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    chars = F.aggregate("lines", F.lit(0), lambda s, x: s + F.length(x) + 1).cast("long")
    name = F.concat(file_name(F.col("title")), F.lit(".md"))
    if prefix:
        name = F.concat(F.format_string("%02d-", F.col("idx")), name)
    out = found.withColumn("idx", F.when(F.col("title").isNull(), 0).otherwise(idx).cast("int"))
    out = out.withColumn("n_lines", F.size("lines").cast("long")).withColumn("n_chars", chars).withColumn("est_tokens", token_estimate(F.col("n_chars")))
    return out.withColumn("filename", F.when(F.col("title").isNull(), F.lit(PREAMBLE_FILE)).otherwise(name))


def contents_table(named: DataFrame, source: Column, split: Column, date: str, key: str = "doc_id") -> DataFrame:
    """(key, toc): the contents page of each document's described sections. `split` is the front-matter line of the rule."""
    row = F.format_string("| %d | [%s](./%s) | %s | %d | ~%s |", F.col("idx"), F.col("filename"), F.col("filename"), F.coalesce("title", F.lit(PREAMBLE_TITLE)), F.col("n_lines"), F.format_number("est_tokens", 0))
    rows = F.array_sort(F.collect_list(F.struct("sec_no", row.alias("row"))))
    each = named.withColumn("__source", source).groupBy(key).agg(F.first("__source").alias("source"), F.count("title").alias("titled"), F.transform(rows, lambda r: r["row"]).alias("rows"))
    stem = F.regexp_replace("source", r"\.[^.]*$", "")
    head = [F.lit("---"), F.format_string('source_file: "%s"', "source"), split, F.lit(f'split_date: "{date}"'), F.format_string("total_chapters: %d", "titled"), F.lit("---"), F.lit(""), F.format_string(f"# %s — {TOC_TITLE}", stem), F.lit(""), *map(F.lit, TOC_HEAD)]
    return each.select(key, F.array_join(F.concat(F.array(*head), F.col("rows"), F.array(F.lit(""), F.lit(TOC_NOTE), F.lit(""))), "\n").alias("toc"))


def clashing_names(named: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, filename, n) of file names that several sections of a document share."""
    return named.groupBy(key, "filename").agg(F.count("*").alias("n")).where("n > 1")


# headings of scanned articles

# What marks author lines and section names among first-level headings.
AUTHOR = r"et\s+al\.|[A-Za-z]+[a-z],[a-z]\b|[A-Z][a-z]+\*\s*$|,\s*[a-z]\s*$|[A-Z][a-z]+-[A-Z][a-z]+\s+[A-Z][a-z]+,"
SECTION = (
    r"(?i)^(?:Abstract|Introduction|Conclusion|Discussion|Results?|Experimental|Methods?|References?|Acknowledgment|Supporting\s+Information"
    r"|Conflicts?\s+of\s+interest|Notes?\s+and\s+references?|Author\s+contributions?|Funding|Keywords?|ChemComm|JACS|Angew|OrgLett)$"
)


def author_line(c: Column) -> Column:
    return c.rlike(AUTHOR)


def section_name(c: Column) -> Column:
    return F.trim(c).rlike(SECTION)


def one_title(text: Column) -> Column:
    """First-level headings after the first run become second-level ones or, for author lines, plain text; the first run,
    with the empty lines in it, is one heading. It ends before an author line, a section name or other text.

    One pass over the lines with a small state: nothing seen, in the run, or past it.
    """
    lines = F.split(text, "\n")
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("title"), F.lit(0).alias("gap"), F.array().cast("array<string>").alias("out"))

    def heading(x: Column) -> Column:
        return x.startswith("# ")

    def make(at: Column, title: Column, gap: Column, out: Column) -> Column:
        return F.struct(at.alias("at"), title.alias("title"), gap.alias("gap"), out.alias("out"))

    def later(x: Column) -> Column:
        own = F.substring(x, 3, 1 << 30)
        return F.when(~heading(x), x).when(author_line(own), own).otherwise(F.concat(F.lit("## "), own))

    def step(s: Column, x: Column) -> Column:
        own = F.substring(x, 3, 1 << 30)
        stops = author_line(own) | section_name(own)
        flushed = F.concat(s["out"], F.array(F.concat(F.lit("# "), s["title"])))
        # empty lines between the run and what ends it stay only before text that is no heading
        blanks = F.when(heading(x), F.array().cast("array<string>")).otherwise(F.array_repeat(F.lit(""), s["gap"]))
        return (
            F.when((s["at"] == 0) & heading(x), make(F.lit(1), own, F.lit(0), s["out"]))
            .when((s["at"] == 1) & (x == ""), make(F.lit(1), s["title"], s["gap"] + 1, s["out"]))
            .when((s["at"] == 1) & heading(x) & ~stops, make(F.lit(1), F.concat(s["title"], F.lit(" "), own), F.lit(0), s["out"]))
            .when(s["at"] == 1, make(F.lit(2), F.lit(""), F.lit(0), F.concat(flushed, blanks, F.array(later(x)))))
            .when(s["at"] == 2, make(F.lit(2), F.lit(""), F.lit(0), F.concat(s["out"], F.array(later(x)))))
            .otherwise(make(s["at"], s["title"], s["gap"], F.concat(s["out"], F.array(x))))
        )

    def finish(s: Column) -> Column:
        last = F.concat(s["out"], F.array(F.concat(F.lit("# "), s["title"])), F.array_repeat(F.lit(""), s["gap"]))
        return F.array_join(F.when(s["at"] == 1, last).otherwise(s["out"]), "\n")

    return F.aggregate(lines, state, step, finish)
