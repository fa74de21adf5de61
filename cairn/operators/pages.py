"""Fetched pages: outcomes, exact dedup, cache states, versions, change and watch history, host pacing."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions.identity import jitter
from cairn.functions.texts import fingerprint

#: Markers of challenge pages.
CHALLENGE = "captcha|cf-chl|challenge-platform|checking your connection before continuing|please verify your browser|verify you are human|just a moment"
#: Content types that count as text, and those of documents.
TEXT_TYPES = ("application/xml", "application/rss+xml", "application/xhtml+xml", "application/json")
DOCUMENT_TYPES = ("application/msword", "application/rtf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/vnd.oasis.opendocument.text")
#: Outcomes worth another attempt.
RETRYABLE = ("capacity_unavailable", "upstream_timeout", "deadline_cancelled", "upstream_failure", "rate_limited")


def is_challenge(markdown: Column, html: Column) -> Column:
    """Markers within the first 16384 characters of Markdown and HTML, where challenge pages have them; articles may cite them later."""
    return F.lower(F.substring(F.concat(F.coalesce(markdown, F.lit("")), F.lit("\n"), F.coalesce(html, F.lit(""))), 1, 16384)).rlike(CHALLENGE)


def is_empty_shell(html: Column) -> Column:
    body = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1\s*>", ""), r"<[^>]*>", "")
    return F.coalesce(F.lower(html).contains("<script") & (F.length(F.trim(F.regexp_replace(body, r"\s+", " "))) < 32), F.lit(False))


def outcome_code(status: Column, content_type: Column, markdown: Column, html: Column, max_bytes: int, capabilities: Column | None = None, unsafe: Column | None = None, robots_denied: Column | None = None, success: Column | None = None) -> Column:
    """Closed outcome of a fetch, first match wins; flags that are not given count as unknown."""
    no = F.lit(False)
    caps = F.coalesce(capabilities, F.array().cast("array<string>")) if capabilities is not None else F.array().cast("array<string>")
    kind = F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1))))
    typed = F.coalesce(content_type != "", no)
    size = F.coalesce(F.octet_length(markdown), F.lit(0)) + F.coalesce(F.octet_length(html), F.lit(0))
    missing = (typed & (kind == "application/pdf") & ~F.array_contains(caps, "pdf")) | (typed & kind.isin(*DOCUMENT_TYPES) & ~F.array_contains(caps, "document"))
    text = kind.startswith("text/") | kind.isin(*TEXT_TYPES, *DOCUMENT_TYPES, "application/pdf")
    return (
        F.when(F.coalesce(unsafe, no) if unsafe is not None else no, "unsafe_redirect")
        .when(status == 429, "rate_limited")
        .when(F.coalesce(robots_denied, no) if robots_denied is not None else no, "robots_refused")
        .when(is_challenge(markdown, html), "challenge")
        .when(~F.coalesce(success, F.lit(True)) if success is not None else no, "upstream_failure")
        .when(missing, "unsupported_capability")
        .when(typed & ~text, "unsupported_content")
        .when(size > max_bytes, "content_too_large")
        .when(F.coalesce(F.length(markdown), F.lit(0)) > 0, "content")
        .when(is_empty_shell(html), "empty_shell")
        .otherwise("extraction_empty")
    )


def first_copies(pages: DataFrame, text_col: str, order_col: str) -> DataFrame:
    """The first page of every content (white space ignored) with the size of its class, and null texts dropped.

    Only (fingerprint, order) is aggregated, combined before the shuffle; texts are not moved.
    """
    marked = pages.filter(F.col(text_col).isNotNull()).withColumn("fingerprint", fingerprint(F.col(text_col)))
    firsts = marked.groupBy("fingerprint").agg(F.min(order_col).alias(order_col), F.count("*").alias("copies"))
    return firsts


def latest_versions(pages: DataFrame, key_col: str, at_col: str, id_col: str) -> DataFrame:
    """The newest row of every key (ties: largest id), as an aggregation."""
    cols = [c for c in pages.columns if c != key_col]
    return pages.groupBy(key_col).agg(F.max_by(F.struct(*cols), F.struct(F.coalesce(at_col, F.lit(float("-inf"))), id_col)).alias("_v")).select(key_col, "_v.*")


def cache_state(now: Column, expires: Column, retained: Column, stale_seconds: float) -> Column:
    return F.when(retained <= now, "gone").when(now < expires, "fresh").when(now < expires + stale_seconds, "stale").otherwise("refresh")


def cacheable(outcome: Column, status: Column) -> Column:
    """Content, and tombstones of pages that are gone."""
    return F.coalesce((outcome == "content") | ((outcome == "upstream_failure") & status.isin(404, 410)), F.lit(False))


def bypass_reason(capabilities: Column, enabled: bool, raw_html_enabled: bool) -> Column:
    return (
        F.when(F.lit(not enabled), "disabled")
        .when(F.array_contains(capabilities, "raw_html") & F.lit(not raw_html_enabled), "raw_html_persistence_disabled")
        .when(F.arrays_overlap(capabilities, F.array(F.lit("pdf"), F.lit("document"))), "unsupported_persistent_capability")
    )


def changes(observations: DataFrame, key_col: str, at_col: str, id_col: str, hash_col: str, status_col: str) -> DataFrame:
    """Each observation against the one before: new, same, changed or removed."""
    w = Window.partitionBy(key_col).orderBy(F.asc_nulls_first(at_col), id_col)
    gone = F.col(status_col).isin(404, 410)
    prev_hash, prev_status = F.lag(hash_col).over(w), F.lag(status_col).over(w)
    first = F.lag(id_col).over(w).isNull()
    change = (
        F.when(gone & ~first & ~F.coalesce(prev_status.isin(404, 410), F.lit(False)), "removed")
        .when(first, "new")
        .when(F.col(hash_col).eqNullSafe(prev_hash) & F.col(status_col).eqNullSafe(prev_status), "same")
        .otherwise("changed")
    )
    return observations.withColumn("change", change)


def watch_transitions(observations: DataFrame, key_col: str, at_col: str, id_col: str, value_col: str) -> DataFrame:
    """``baseline``: the last value seen before; it survives observations without a value. ``fired``: value and baseline differ."""
    w = Window.partitionBy(key_col).orderBy(F.asc_nulls_first(at_col), id_col).rowsBetween(Window.unboundedPreceding, -1)
    base = F.last(value_col, ignorenulls=True).over(w)
    return observations.withColumn("baseline", base).withColumn("fired", F.coalesce(base != F.col(value_col), F.lit(False)))


def backoff(observations: DataFrame, host_col: str, at_col: str, id_col: str, status_col: str, most: int = 300, retry_after: Column | None = None) -> DataFrame:
    """Refusals (403, 429) per host since the last success; ``delay`` doubles up to ``most`` seconds, or is what the site asked for if longer."""
    w = Window.partitionBy(host_col).orderBy(F.asc_nulls_first(at_col), id_col)
    reset, refused = F.col(status_col).between(200, 399), F.coalesce(F.col(status_col).isin(403, 429), F.lit(False))
    islands = observations.withColumn("_island", F.sum(F.when(reset, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(host_col, "_island").orderBy(F.asc_nulls_first(at_col), id_col).rowsBetween(Window.unboundedPreceding, 0)
    adaptive = F.least(F.lit(most), F.pow(F.lit(2), F.least("failures", F.lit(10))).cast("int")).cast("long")
    asked = F.coalesce(retry_after.cast("long"), F.lit(0).cast("long")) if retry_after is not None else F.lit(0).cast("long")
    counted = islands.withColumn("failures", F.sum(F.when(refused, 1).otherwise(0)).over(inside))
    return counted.withColumn("delay", F.when(refused, F.greatest(adaptive, asked)).otherwise(0)).drop("_island")


def paced_starts(requests: DataFrame, host_col: str, at_col: Column, id_col: str, spacing: float | Column) -> DataFrame:
    """Earliest start of each request when a host's requests keep ``spacing`` seconds: a running maximum, no loop.

    ``spacing`` may be a column that is the same for all rows of a host (``host_spacing``).
    """
    w = Window.partitionBy(host_col).orderBy("_at", id_col)
    timed = requests.withColumn("_at", at_col).withColumn("_gap", spacing if isinstance(spacing, Column) else F.lit(float(spacing))).withColumn("_n", F.row_number().over(w) - 1)
    ahead = F.max(F.col("_at") - F.col("_n") * F.col("_gap")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return timed.withColumn("start_at", ahead + F.col("_n") * F.col("_gap")).withColumn("waited", F.round(F.col("start_at") - F.col("_at"), 6)).drop("_n", "_at", "_gap")


def host_spacing(host: Column, default: float, robots_delay: Column, most_jitter: float) -> Column:
    """The larger of the default and the robots delay, and the host's own jitter."""
    return F.greatest(F.lit(float(default)), F.coalesce(robots_delay.cast("double"), F.lit(0.0))) + jitter(host, most_jitter)


def line_sections(pages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every line with the last heading at or above it, folded within the page's array of lines, without a shuffle."""
    lines = F.split(F.regexp_replace(F.regexp_replace(text_col, "\r\n", "\n"), "\r", "\n"), "\n")
    heads = F.filter(F.transform(lines, lambda x, k: F.struct(k.alias("at"), F.trim(x).alias("line"))), lambda s: s["line"].rlike("^#{1,6} "))
    heads = F.transform(heads, lambda s: F.struct(s["at"].alias("at"), F.trim(F.regexp_replace(s["line"], "^#{1,6} ", "")).alias("head")))
    # Each heading reaches to the next one: a piece of lines per heading, so every line is handled once.
    top = F.struct(F.lit(0).alias("at"), F.lit(None).cast("string").alias("head"))
    pieces = pages.select(id_col, lines.alias("_l"), F.concat(F.array(top), heads).alias("_h")).select(id_col, "_l", "_h", F.posexplode("_h").alias("_k", "_piece"))
    until = F.coalesce(F.try_element_at("_h", F.col("_k") + 2)["at"], F.size("_l"))
    own = pieces.select(id_col, F.col("_piece.at").alias("_at"), F.col("_piece.head").alias("section"), F.slice("_l", F.col("_piece.at") + 1, until - F.col("_piece.at")).alias("_own"))
    return own.select(id_col, "section", "_at", F.posexplode("_own").alias("_n", "line")).select(id_col, (F.col("_at") + F.col("_n")).alias("line_no"), "line", "section")


def diff_lines(previous: str | None, current: str | None, max_lines: int | None = None, max_out: int | None = None) -> dict | None:
    """Added and removed lines between two versions; None for equal ones.

    Equal lines at both ends are set aside first. Only with ``max_lines`` are longer texts not compared, and only with
    ``max_out`` are the lists cut; ``truncated`` marks both.
    """
    if previous == current:
        return None
    old, new = [(x or "").replace("\r\n", "\n").replace("\r", "\n").splitlines() for x in (previous, current)]
    out = {"truncated": False, "n_previous": len(old), "n_current": len(new), "added": [], "removed": []}
    if max_lines is not None and max(len(old), len(new)) > max_lines:
        return out | {"truncated": True}
    head = next((k for k, (a, b) in enumerate(zip(old, new, strict=False)) if a != b), min(len(old), len(new)))
    old, new = old[head:], new[head:]
    tail = next((k for k, (a, b) in enumerate(zip(reversed(old), reversed(new), strict=False)) if a != b), min(len(old), len(new)))
    old, new = old[: len(old) - tail], new[: len(new) - tail]
    for tag, a, b, c, d in difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes():
        if tag != "equal":
            out["removed"] += old[a:b]
            out["added"] += new[c:d]
    if max_out is not None:
        out["truncated"] = len(out["added"]) > max_out or len(out["removed"]) > max_out
        out["added"], out["removed"] = out["added"][:max_out], out["removed"][:max_out]
    return out


DIFF = T.StructType([T.StructField("truncated", T.BooleanType()), T.StructField("n_previous", T.IntegerType()), T.StructField("n_current", T.IntegerType()), T.StructField("added", T.ArrayType(T.StringType())), T.StructField("removed", T.ArrayType(T.StringType()))])


def version_diffs(pages: DataFrame, key_col: str, at_col: str, id_col: str, text_col: str, max_lines: int | None = None, max_out: int | None = None) -> DataFrame:
    """Line differences of each version to the one before; unchanged versions give no row.

    The window carries ids and digests; texts are joined only for versions that changed.
    """
    w = Window.partitionBy(key_col).orderBy(at_col, id_col)
    slim = pages.select(key_col, id_col, at_col, F.sha2(text_col, 256).alias("_h"))
    pairs = slim.withColumn("_p", F.lag(id_col).over(w)).withColumn("_ph", F.lag("_h").over(w)).filter(F.col("_p").isNotNull() & ~F.col("_ph").eqNullSafe(F.col("_h")))
    texts = pages.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    old = pairs.select(key_col, id_col, "_p").join(texts.withColumnRenamed("_t", "_old"), F.col("_p") == F.col("_id")).drop("_id", "_p")
    both = old.join(texts.withColumnRenamed("_t", "_new"), F.col(id_col) == F.col("_id")).drop("_id")

    @F.pandas_udf(DIFF)
    def diff(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for old, new in batches:
            rows = [diff_lines(a, b, max_lines, max_out) or {"truncated": None, "n_previous": None, "n_current": None, "added": None, "removed": None} for a, b in zip(old, new, strict=True)]
            yield pd.DataFrame(rows, columns=DIFF.names)

    return both.select(key_col, id_col, diff("_old", "_new").alias("d")).select(key_col, id_col, "d.*").filter("n_previous IS NOT NULL")
