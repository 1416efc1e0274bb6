"""Documents to numbered lines and back, noise rules, language by signature words."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import prefix_flags, rstrip, strip

# Signature words of the two languages that are told from English.
GERMAN = (
    "und", "die", "der", "das", "den", "dem", "des", "ein", "eine", "einer", "mit", "von", "für", "fur", "auf", "aus", "bei", "nach", "über", "uber", "als", "auch",
    "oder", "aber", "wenn", "wird", "sind", "hat", "ist", "nicht", "kann", "durch", "werden", "wurde", "diese", "dieser", "zwischen", "unter", "ohne", "gegen", "noch", "sehr", "schon",
)
FRENCH = (
    "les", "des", "une", "dans", "pour", "avec", "sur", "par", "qui", "que", "est", "sont", "pas", "plus", "nous", "vous", "mais", "cette", "entre", "comme",
    "leur", "aussi", "peut", "tous", "même", "meme",
)


@dataclass(frozen=True)
class NoiseRules:
    """Patterns (with flags in front) of lines to drop, and the length beyond which a line is always kept."""

    patterns: tuple[str, ...] = ()
    keep_longer_than: int = 150
    flags: tuple[str | None, ...] = field(default=())

    def java(self) -> list[str]:
        flags = self.flags or (None,) * len(self.patterns)
        return [prefix_flags(p, f) for p, f in zip(self.patterns, flags, strict=True)]


def explode_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ln from 0, line) of texts cut at newlines. No shuffle."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("ln", "line"))


def assemble(lines: DataFrame, key: str = "doc_id", order: str = "ln", line: str = "line") -> DataFrame:
    """(key, text): the lines of each document in order, joined by newlines."""
    pairs = F.array_sort(F.collect_list(F.struct(order, line)))
    return lines.groupBy(key).agg(F.array_join(F.transform(pairs, lambda p: p[line]), "\n").alias("text"))


def noise(line: Column, rules: NoiseRules) -> Column:
    """Whether a line is noise: not blank, not longer than the guard, and hit by a rule after stripping."""
    if not rules.patterns:
        return F.lit(False)
    bare = strip(line)
    hit = F.lit(False)
    for pattern in rules.java():
        hit = hit | bare.rlike(pattern)
    return (bare != "") & (F.length(bare) <= rules.keep_longer_than) & hit


def without_noise(text: Column, rules: NoiseRules) -> Column:
    """A text without its noise lines; other lines stay as they are. Without rules the text itself."""
    if not rules.patterns:
        return text
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~noise(x, rules)), "\n")


def page_language(text: Column, least: int = 5) -> Column:
    """de or fr if at least `least` signature words occur and more than of the other language, else en."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))

    def hits(own: tuple[str, ...]) -> Callable[[Column], Column]:
        return lambda w: F.size(F.filter(w, lambda x: x.isin(*own)))

    # each transform over one element binds its value, so the words are cut once and counted once for each language
    counts = F.transform(F.array(words), lambda w: F.struct(hits(GERMAN)(w).alias("de"), hits(FRENCH)(w).alias("fr")))
    named = F.transform(counts, lambda n: F.when((n["de"] >= least) & (n["de"] > n["fr"]), F.lit("de")).when((n["fr"] >= least) & (n["fr"] > n["de"]), F.lit("fr")).otherwise(F.lit("en")))
    return F.get(named, F.lit(0))


def document_language(pages: DataFrame, key: str = "doc_id", page: str = "page_no", text: str = "text", sample: int = 2) -> DataFrame:
    """(key, language) from the first pages; the page filter reaches the scan."""
    first = pages.where(F.col(page) < sample)
    ordered = F.array_sort(F.collect_list(F.struct(page, text)))
    joined = first.groupBy(key).agg(F.array_join(F.transform(ordered, lambda p: p[text]), "\n").alias("t"))
    return joined.select(key, page_language(F.col("t")).alias("language"))


def frontmatter_end(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """lines with `head`: whether a line belongs to front matter that opens in line 0 and closes with the next `---`."""
    fence = rstrip(F.col("line")) == "---"
    close = F.min(F.when((F.col("ln") > 0) & fence, F.col("ln")))
    ends = lines.groupBy(key).agg(F.max((F.col("ln") == 0) & fence).alias("opens"), close.alias("close"))
    return lines.join(ends, key).withColumn("head", F.coalesce(F.col("opens") & (F.col("ln") <= F.col("close")), F.lit(False))).drop("opens", "close")


def repeated_lines(lines: DataFrame, group: str, page: str, share: float = 0.5, least_pages: int = 3) -> DataFrame:
    """(group, line, n_pages): lines that stand on at least `share` of a group's pages, if it has enough pages."""
    pages = lines.groupBy(group).agg(F.count_distinct(page).alias("pages"))
    found = lines.where(F.col("line") != "").select(group, page, "line").distinct().groupBy(group, "line").agg(F.count("*").alias("n_pages"))
    kept = found.join(pages, group).where((F.col("pages") >= least_pages) & (F.col("n_pages") >= share * F.col("pages")))
    return kept.select(group, "line", "n_pages")


def check_pattern(pattern: str) -> str:
    """A user's pattern if Python can compile it, else ValueError."""
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"invalid pattern {pattern!r}: {e}") from e
    return pattern
