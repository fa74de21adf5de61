"""Line-wise cleaning of Markdown in native expressions: menus, link lists to the own site and separators go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MENU = r"^\s*[*+-]?\s*(\[[^\]]*\]\(/[^)]*\)\s*[|·]?\s*)+$"
PATHS = r"^[^.!?]*(›| · )[^.!?]*$"


def kept_lines(markdown: Column) -> Column:
    """The lines that are no menu and no path, trailing white space removed, in order."""
    lines = F.transform(F.split(F.regexp_replace(markdown, "\r", ""), "\n"), lambda x: F.rtrim(x))
    return F.filter(lines, lambda x: ~(x.rlike(MENU) | x.rlike(PATHS)))


def clean(markdown: Column) -> Column:
    return F.trim(F.regexp_replace(F.array_join(kept_lines(markdown), "\n"), "\n{3,}", "\n\n"))


def totals(pages: DataFrame, text_col: str, *keys: str) -> DataFrame:
    """Characters before and after cleaning and dropped lines, per key."""
    before = F.size(F.split(text_col, "\n"))
    rows = pages.select(*keys, F.length(text_col).alias("b"), F.length(clean(F.col(text_col))).alias("a"), (before - F.size(kept_lines(F.col(text_col)))).alias("d"))
    return rows.groupBy(*keys).agg(F.sum("b").alias("chars_before"), F.sum("a").alias("chars_after"), F.sum("d").alias("lines_dropped"), F.count("*").alias("n_pages"))


def removed_lines(before: DataFrame, after: DataFrame) -> DataFrame:
    """Lines of the first table not matched in the second, with multiplicity."""
    return before.exceptAll(after)
