"""Page ranges such as 1-5,10 and the coordinate notations of figure fixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def page_set(spec: Column, total: Column) -> Column:
    """Sorted 0-based pages of a 1-based range list; null: all, blank: none, ranges are clamped, single pages outside go.
    A part that is no number raises."""
    part = F.filter(F.transform(F.split(spec, ","), lambda p: F.trim(p)), lambda p: p != "")

    def pages(p: Column) -> Column:
        a = F.when(p.rlike(r"^-"), F.lit(None)).otherwise(F.trim(F.split_part(p, F.lit("-"), F.lit(1))))
        b = F.when(p.contains("-") & ~p.rlike(r"^-"), F.trim(F.split_part(p, F.lit("-"), F.lit(2))))
        lo, hi = F.greatest(F.lit(1), a.cast("int")), F.least(total, b.cast("int"))
        single = F.when(a.cast("int").between(1, total), F.array(a.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
        span = F.when(lo <= hi, F.sequence(lo - 1, hi - 1)).otherwise(F.array().cast("array<int>"))
        return F.when(b.isNotNull(), span).when(a.isNotNull(), single).otherwise(F.array().cast("array<int>"))

    every = F.when(total > 0, F.sequence(F.lit(0), total - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(spec.isNull(), every).otherwise(F.array_sort(F.array_distinct(F.flatten(F.transform(part, pages)))))


def figure_pages(spec: Column, total: Column) -> Column:
    """Sorted distinct 1-based pages inside the document; nothing is clamped, a negative number raises."""
    part = F.filter(F.transform(F.split(spec, ","), lambda p: F.trim(p)), lambda p: p != "")

    def pages(p: Column) -> Column:
        a, b = F.split_part(p, F.lit("-"), F.lit(1)), F.split_part(p, F.lit("-"), F.lit(2))
        lo, hi = a.cast("int"), F.when(p.contains("-"), b.cast("int")).otherwise(a.cast("int"))
        return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))

    return F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(part, pages)), lambda p: p.between(F.lit(1), total))))


def shifted(value: Column, change: Column, height: Column) -> Column:
    """A y ratio moved by a change such as +0.05, -0.02 or +30pt (points of a page of the given height)."""
    number = F.regexp_extract(change, r"^([+-]?[0-9.]+)", 1).cast("double")
    return value + F.when(change.endswith("pt"), number / height).otherwise(number)


def coordinate(text: Column, height: Column) -> Column:
    """A y ratio from 0.25 or 180pt."""
    number = F.regexp_extract(text, r"^([0-9.]+)", 1).cast("double")
    return F.when(text.endswith("pt"), number / height).otherwise(number)
