"""Text functions: each takes and returns Columns, so Catalyst sees plain expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ligature characters and what they stand for.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
REPLACEMENT = "�"


def strip(c: Column) -> Column:
    """Without white space (Unicode) at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def unix_newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def split_lines(c: Column) -> Column:
    """Lines at every Unicode line break, the breaks dropped; a final break adds no line."""
    lines = F.split(c, "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")
    return F.when((F.size(lines) > 0) & (F.element_at(lines, -1) == ""), F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def ligatures(c: Column) -> Column:
    for char, plain in LIGATURES.items():
        c = F.replace(c, F.lit(char), F.lit(plain))
    return c


def degree_signs(c: Column) -> Column:
    """A temperature's misread degree sign: 1C after a number."""
    return F.regexp_replace(c, r"(\d)\s*1C\b", "$1 °C")


def drop_caps(c: Column) -> Column:
    """A lone capital, an empty line and a line in lower case are one word again."""
    return F.regexp_replace(c, r"(?m)^([A-Z])\n\n([a-z])", "$1$2")


@F.pandas_udf(T.StringType())
def _composed(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


#: Characters that normal form C leaves alone, whatever stands beside them among each other: Latin, basic Greek and Cyrillic,
#: common punctuation, kana, ideographs.
STABLE = r"\x00-\u02ff\u0400-\u0482\u048a-\u052f\u2010-\u2027\u3001-\u3029\u3041-\u3098\u309b-\u30ff\u4e00-\u9fff\uff01-\uff5e"


def nfc(c: Column) -> Column:
    """Unicode normal form C. Only texts with a character that it may change travel to Python; for others a null does."""
    return F.coalesce(_composed(F.when(c.rlike(f"[^{STABLE}]"), c)), c)


def garbled_lines(c: Column) -> Column:
    """Lines with at least five replacement characters that make up a fifth of them become a rule."""

    def one(line: Column) -> Column:
        bare = strip(line)
        lost = F.length(bare) - F.length(F.replace(bare, F.lit(REPLACEMENT), F.lit("")))
        return F.when((lost >= 5) & (lost * 5 >= F.length(bare)), F.lit("---")).otherwise(line)

    return F.array_join(F.transform(F.split(c, "\n"), one), "\n")


def without_empty_tables(c: Column) -> Column:
    """One-column tables without content go, with or without rows."""
    # The two shapes of such a table.
    c = F.regexp_replace(c, r"(?m)(?:^\|[ \t]*\|\n)+\| ?-{3,} ?\|\n(?:^\|[ \t]*\|\n)+", "")
    return F.regexp_replace(c, r"(?m)^\|[ \t]*\|\n\| ?-{3,} ?\|\n", "")


def squeeze(c: Column) -> Column:
    """At most one empty line in a row, no white space at line ends, a final newline."""
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    c = F.array_join(F.transform(F.split(c, "\n"), rstrip), "\n")
    return F.when(c.endswith("\n"), c).otherwise(F.concat(c, F.lit("\n")))


def post_process(c: Column) -> Column:
    return squeeze(without_empty_tables(nfc(garbled_lines(c))))


def significant_length(c: Column) -> Column:
    """Characters of a Markdown text that are neither front matter nor marks nor white space."""
    body = F.regexp_replace(c, r"(?s)^---\n.*?\n---\n", "")
    return F.length(F.regexp_replace(body, r"(?U)[#|\-*>\[\]()!`\s]", ""))


def sufficient(c: Column, least: int = 100) -> Column:
    return significant_length(c) >= least


def token_estimate(chars: Column) -> Column:
    """Characters over 1.5, cut."""
    return F.floor(chars / 1.5).cast("long")


def file_name(title: Column) -> Column:
    """A file name from a heading; `untitled` if nothing is left."""
    c = F.regexp_replace(strip(title), r"(?U)^#+\s*", "")
    c = F.regexp_replace(c, "[*_`~]", "")
    c = F.regexp_replace(c, r"\.{2,}", "")
    c = strip(F.regexp_replace(c, r"(?U)\s*\d+\s*$", ""))
    c = F.regexp_replace(c, r'[/\\:?<>"|]', "-")
    c = F.regexp_replace(c, r"(?U)\s+", "-")
    c = F.regexp_replace(F.regexp_replace(c, "-{2,}", "-"), "^-+|-+$", "")
    c = F.when(F.length(c) > 80, F.regexp_replace(F.substring(c, 1, 80), "-+$", "")).otherwise(c)
    return F.when(c == "", F.lit("untitled")).otherwise(c)


def anchor_key(c: Column) -> Column:
    """What two spellings of a heading share: no marks, no white space, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(strip(c), r"(?U)^#+\s*", ""), r"(?U)\s+", ""))


def page_number(c: Column) -> Column:
    """Whether a line holds nothing but a page number."""
    # The spellings of a page number.
    return c.rlike(r"(?U)^\s*(?:\d+|[Pp][Aa][Gg][Ee]\s+\d+|-\s*\d+\s*-|第\s*\d+\s*頁|\d+\s*/\s*\d+)\s*$")


def number_text(number: Column) -> Column:
    """A double as the shortest decimal that names it: whole numbers without a point, an exponent below 0.0001 only; nan, inf
    and -inf by name. Beyond 10**15 a whole number's digits are those of the shortest decimal, filled with zeros."""
    size = F.abs(number)
    short = number.cast("string")
    small = F.regexp_replace(number.try_cast("decimal(38,22)").cast("string"), "0+$", "")
    large = F.regexp_replace(number.try_cast("decimal(38,10)").cast("string"), r"\.?0+$", "")
    power = F.regexp_extract(short, r"E(-?\d+)$", 1).try_cast("int")
    raised = F.concat(F.regexp_replace(F.regexp_extract(short, "^(.*)E", 1), r"\.0$", ""), F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")), F.format_string("%02d", F.abs(power)))
    return (
        F.when(F.isnan(number), F.lit("nan"))
        .when(size == float("inf"), F.when(number > 0, F.lit("inf")).otherwise(F.lit("-inf")))
        .when((number == F.floor(number)) & (size < 1e15), number.try_cast("bigint").cast("string"))
        .when(size >= 1e15, F.format_string("%.0f", number))
        .when(size >= 1e7, large)
        .when(size >= 1e-3, short)
        .when(size >= 1e-4, small)
        .otherwise(raised)
    )


def cell(kind: Column, text: Column, number: Column, when: Column, truth: Column) -> Column:
    """A spreadsheet cell as Markdown: dates by day, numbers by number_text (or as the reader wrote them), other text on one
    escaped line."""
    value = (
        F.when(kind == "bool", F.when(truth, F.lit("TRUE")).otherwise(F.lit("FALSE")))
        .when(kind == "date", F.date_format(when, "yyyy-MM-dd"))
        .when(kind == "float", F.coalesce(text, number_text(number)))
        .otherwise(F.replace(F.regexp_replace(text, "\n", " "), F.lit("|"), F.lit("\\|")))
    )
    return F.coalesce(value, F.lit(""))


def prefix_flags(pattern: str, flags: str | None) -> str:
    """A pattern with its flags in front, for Java and Unicode."""
    # Flag names of rule files.
    known = {"IGNORECASE": "iu", "MULTILINE": "m", "DOTALL": "s", "VERBOSE": "x"}
    found = "".join(known[f.strip().upper()] for f in (flags or "").split("|") if f.strip().upper() in known)
    return f"(?U{found})" + pattern
