"""Passages: quality gate, prefilter, score repair, budgets, citations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions.texts import overlap
from cairn.functions.url import normalize_url

#: Labels and terms of the quality rules.
NAVIGATION = ("home", "menu", "search", "login", "log in", "sign in", "sign up", "register", "skip to content")
FOOTER = ("all rights reserved", "copyright", "privacy policy", "terms of service", "cookie policy")
GENERIC = (*NAVIGATION, "one", "two", "three", "four", "five", "six", "click here", "read more", "learn more", "next", "previous")
#: The form of a link and the limits of the rules (characters, lines, terms, shares) below.
LINK = r"\[([^\]]+)\]\([^)]+\)"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, LINE_BREAK), lambda x: F.lower(F.trim(x))), lambda x: x != "")


def drop_reason(text: Column) -> Column:
    """First quality rule that a text breaks; null for sound texts."""
    lines = _lines(text)
    n = F.size(lines)
    nav = F.size(F.filter(lines, lambda x: x.isin(*NAVIGATION)))
    navigation = (F.length(text) <= 300) & (n >= 3) & (nav >= 3) & (nav / n >= 0.6)
    foot = F.size(F.filter(lines, lambda x: F.greatest(*[x.contains(t) for t in FOOTER])))
    footer = (F.length(text) <= 500) & (n >= 3) & (foot >= 2) & (F.aggregate(lines, F.lit(0), lambda a, x: a + F.length(x)) / n < 60)
    labels = F.transform(F.regexp_extract_all(text, F.lit(LINK), F.lit(1)), lambda x: F.lower(F.trim(x)))
    links = (F.size(labels) >= 6) & (F.length(F.trim(F.regexp_replace(text, LINK, "$1"))) < 120) & (F.size(F.filter(labels, lambda x: x.isin(*GENERIC))) / F.size(labels) >= 0.8)
    return F.when(navigation, "navigation_boilerplate").when(footer, "footer_boilerplate").when(links, "link_dominated")


def prefilter_score(query: Column, text: Column, title: Column, position: Column) -> Column:
    return overlap(query, text) + 0.35 * overlap(query, F.coalesce(title, F.lit(""))) + 1.0 / ((position + 1) * 100.0)


def term_counts(text: Column, terms: list[str]) -> tuple[Column, Column]:
    """(number of words, how often each of ``terms`` occurs among them); words as in ``tokens``."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda w: F.length(w) > 1)
    hits = F.filter(words, lambda w: w.isin(terms))
    return F.size(words), F.transform(F.array(*[F.lit(t) for t in terms]), lambda t: F.size(F.filter(hits, lambda w: w == t)))


def bm25(counted: DataFrame, words_col: str, counts_col: str, n_terms: int, k: float = 1.2, b: float = 0.75) -> DataFrame:
    """Adds ``score`` (BM25) from the columns of ``term_counts``. What all rows have in common is one row."""
    having = F.array(*[F.count_if(F.col(counts_col)[i] > 0) for i in range(n_terms)])
    common = counted.agg(F.count("*").alias("_n"), F.greatest(F.avg(words_col), F.lit(1.0)).alias("_mean"), having.alias("_having"))
    norm = k * (1 - b + b * F.col(words_col) / F.col("_mean"))
    score = F.lit(0.0)
    for i in range(n_terms):
        tf, df = F.col(counts_col)[i], F.col("_having")[i]
        score = score + F.log(1 + (F.col("_n") - df + 0.5) / (df + 0.5)) * tf * (k + 1) / (tf + norm)
    return counted.crossJoin(F.broadcast(common)).withColumn("score", score).drop("_n", "_mean", "_having")


def prefilter(chunks: DataFrame, source_col: str, score_col: str, index_col: str, keep: int = 50) -> DataFrame:
    """The ``keep`` best chunks, in order of score: the best of each source have precedence; a top-k, not a global sort."""
    best = F.row_number().over(Window.partitionBy(source_col).orderBy(F.desc(score_col), index_col)) == 1
    return chunks.withColumn("_best", best).orderBy(F.desc("_best"), F.desc(score_col), index_col).limit(keep).orderBy(F.desc(score_col), index_col).drop("_best")


def floor_fill(scored: DataFrame, group_col: str, score_col: str = "score") -> DataFrame:
    """Missing scores become the group's lowest score minus one (0 without any); the minimum is combined before the join."""
    low = scored.groupBy(group_col).agg(F.min(score_col).alias("_low"))
    filled = scored.join(low.withColumnRenamed(group_col, "_g"), F.col(group_col).eqNullSafe(F.col("_g")), "left")
    return filled.withColumn(score_col, F.coalesce(F.col(score_col), F.col("_low") - 1, F.lit(0.0))).drop("_g", "_low")


def token_fill(scored: DataFrame, group_col: str, order: list[Column], budget: int, max_passages: int | None = None, tokens_col: str = "token_count") -> DataFrame:
    """Whole passages in order until the budget is used up, the last one cut to what is left (``used_tokens``)."""
    w = Window.partitionBy(group_col).orderBy(*order)
    prior = F.coalesce(F.sum(tokens_col).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = scored.withColumn("_prior", prior).withColumn("rank", F.row_number().over(w)).filter(F.col("_prior") < budget)
    if max_passages is not None:
        out = out.filter(F.col("rank") <= max_passages)
    return out.withColumn("used_tokens", F.least(F.col(tokens_col), budget - F.col("_prior"))).drop("_prior")


def citations(passages: DataFrame, group_col: str, key: Column, rank_col: str = "rank") -> DataFrame:
    """Passages grouped by cited document (``citation_key_of``) in order of first use, with the number of distinct spans."""
    per = passages.withColumn("_key", key).groupBy(group_col, "_key").agg(F.min(rank_col).alias("first_rank"), F.count("*").alias("n_passages"), F.count_distinct("start_index", "end_index").alias("n_spans"))
    return per.withColumn("citation_id", F.row_number().over(Window.partitionBy(group_col).orderBy("first_rank"))).withColumnRenamed("_key", "citation_key")


def citation_key_of(document: Column, source_url: Column) -> Column:
    """What a passage cites: its document, or where that is unknown the merge key of its URL."""
    return F.coalesce(document, normalize_url(source_url))


def byte_envelope(items: DataFrame, group_col: str, order_cols: list[str], bytes_col: str, item_bytes: int, list_bytes: int, max_items: int | None = None, reserve: int = 0, between: int = 0, mark: str | None = None) -> DataFrame:
    """Items in order that fit one by one into a byte budget; those that do not fit are skipped and the scan goes on.

    ``reserve`` bytes are used before the first item and ``between`` before each later one. With ``mark`` all items come
    out and that column tells which are kept.

    A streaming fold over sorted partitions: a task holds one batch and one number, whatever a group's size.
    """
    small = F.coalesce(F.col(bytes_col) <= item_bytes, F.lit(False))
    sized = (items.filter(small) if mark is None else items.withColumn(mark, small)).repartition(group_col).sortWithinPartitions(group_col, *order_cols)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, used, kept = object(), reserve, 0
        for pdf in batches:
            keep = []
            for g, n, ok in zip(pdf[group_col], pdf[bytes_col], pdf[mark] if mark else [True] * len(pdf), strict=True):
                if g != group:
                    group, used, kept = g, reserve, 0
                more = int(n) + (between if kept else 0) if ok else 0
                fits = bool(ok) and used + more <= list_bytes and (max_items is None or kept < max_items)
                if fits:
                    used, kept = used + more, kept + 1
                keep.append(fits)
            chosen = pd.Series(keep, index=pdf.index, dtype=bool)
            yield pdf[chosen] if mark is None else pdf.assign(**{mark: chosen})

    return sized.mapInPandas(run, sized.schema)


def cut_utf8(max_bytes: int):
    """Arrow UDF: the longest prefix of at most ``max_bytes`` UTF-8 bytes that ends at a character."""

    @F.pandas_udf(T.StringType())
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None or len(t.encode()) <= max_bytes else t.encode()[:max_bytes].decode("utf-8", "ignore"))

    return cut
