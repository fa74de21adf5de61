"""The page cache and its targets as tables: keys, records, lookups, deletes, refresh decisions; robots snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.operators.pages import cacheable, latest_versions

ROBOTS_FAILURE_SECONDS = 60.0


def build_records(results: DataFrame, key: Column, identity: Column, now: Column, ttl: float, retention: float, cleaner: str, raw_html: bool) -> DataFrame:
    """Cache records of cacheable results: keys, digest of the Markdown, times; raw HTML only if it may be kept."""
    kept = results.filter(cacheable(F.col("outcome"), F.col("status_code")))
    return (
        kept.withColumn("cache_key", key).withColumn("url_identity", identity).withColumn("cleaner_version", F.lit(cleaner))
        .withColumn("source_hash", F.sha2(F.coalesce("markdown", F.lit("")), 256)).withColumn("raw_html", F.when(F.lit(raw_html), F.col("raw_html")))
        .withColumn("fetched_at", now).withColumn("expires_at", now + ttl).withColumn("retained_until", now + retention)
    )


def lookup(requests: DataFrame, cache: DataFrame, key_col: str, now: float) -> DataFrame:
    """Requests with the newest retained record of their key; others miss. Records past retention are read as missing."""
    alive = cache.filter(F.col("retained_until") > now)
    newest = latest_versions(alive, key_col, "fetched_at", "record_id").withColumn("hit", F.lit(True))
    return requests.join(newest, key_col, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def empty_cache(cache: DataFrame) -> DataFrame:
    """The disabled cache: its schema without rows."""
    return cache.limit(0)


def upsert(stored: DataFrame, fresh: DataFrame, keys: list[str], at_col: str) -> DataFrame:
    """Stored rows with fresh ones in their place: the latest by ``at_col``, fresh before stored at equal times."""
    cols = [c for c in stored.columns if c not in keys]
    both = stored.withColumn("_new", F.lit(0)).unionByName(fresh.select(*stored.columns).withColumn("_new", F.lit(1)))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(F.coalesce(F.col(at_col).cast("double"), F.lit(float("-inf"))), "_new")).alias("_v")).select(*keys, "_v.*")


def targets_of(targets: DataFrame, cache: DataFrame, now: float) -> DataFrame:
    """Target snapshots whose page is still in the cache, with its record."""
    pages = cache.filter(F.col("retained_until") > now).groupBy("cache_key").agg(F.max_by("record_id", F.struct("fetched_at", "record_id")).alias("record_id"))
    return targets.join(pages, "cache_key")


def deleted(cache: DataFrame, keys: DataFrame | None = None, urls: DataFrame | None = None, now: float | None = None) -> DataFrame:
    """The cache without given keys, without given URL identities and without records past retention."""
    out = cache
    if keys is not None:
        out = out.join(keys.select("cache_key").distinct(), "cache_key", "left_anti")
    if urls is not None:
        out = out.join(urls.select("url_identity").distinct(), "url_identity", "left_anti")
    return out if now is None else out.filter(F.col("retained_until") > now)


def cascade(targets: DataFrame, cache: DataFrame) -> DataFrame:
    """Targets whose page is left."""
    return targets.join(cache.select("cache_key").distinct(), "cache_key", "left_semi")


def validators(headers: Column, capabilities: Column) -> Column:
    """(etag, last_modified) to ask with, or null where a conditional request is no use: none stored, or JavaScript wanted."""
    by_name = F.transform_keys(headers, lambda k, _: F.lower(k))
    etag, modified = F.try_element_at(by_name, F.lit("etag")), F.try_element_at(by_name, F.lit("last-modified"))
    some = (F.coalesce(etag, F.lit("")) != "") | (F.coalesce(modified, F.lit("")) != "")
    return F.when(some & ~F.coalesce(F.array_contains(capabilities, "javascript"), F.lit(False)), F.struct(etag.alias("etag"), modified.alias("last_modified")))


def revalidated(records: DataFrame, answer: Column, now: Column, ttl: float) -> DataFrame:
    """Records after a conditional request: 304 renews ``fetched_at`` and ``expires_at``, never ``retained_until``."""
    same = F.coalesce(answer == 304, F.lit(False))
    return records.withColumn("fetched_at", F.when(same, now).otherwise(F.col("fetched_at"))).withColumn("expires_at", F.when(same, now + ttl).otherwise(F.col("expires_at"))).withColumn("refreshed", same)


def refresh_decisions(requests: DataFrame, cache: DataFrame, key_col: str, id_col: str, at_col: str) -> DataFrame:
    """One refresh per key: of the requests that saw the same baseline the first fetches, others reuse what it or any newer record gives.

    ``requests`` has ``baseline_at`` (the record a request saw, null for none); adds ``action``: fetch, wait or reuse.
    """
    newest = cache.groupBy(key_col).agg(F.max("fetched_at").alias("_at"))
    first = requests.groupBy(key_col).agg(F.min_by(id_col, F.struct(at_col, id_col)).alias("_first"))
    joined = requests.join(newest, key_col, "left").join(first, key_col)
    newer = F.coalesce(F.col("_at") > F.coalesce(F.col("baseline_at"), F.lit(float("-inf"))), F.lit(False))
    return joined.withColumn("action", F.when(newer, "reuse").when(F.col(id_col) == F.col("_first"), "fetch").otherwise("wait")).drop("_at", "_first")


def robots_fresh(snapshots: DataFrame, now: float, ttl: float) -> DataFrame:
    """Robots snapshots still valid: ``ttl`` seconds, those of unreachable origins at most a minute."""
    if not 0 < ttl <= 86_400:
        raise ValueError("ttl must lie between 0 and 86400 seconds")
    own = F.when(F.col("state") == "unreachable", F.lit(min(ttl, ROBOTS_FAILURE_SECONDS))).otherwise(F.lit(float(ttl)))
    return snapshots.filter(F.col("fetched_at") + own > now)


def cache_use_allowed(records: DataFrame, decisions: DataFrame, url_cols: list[str]) -> DataFrame:
    """Whether robots decisions allow every URL of a record (null URLs aside); a URL without decision is not allowed.

    ``decisions`` has ``url`` and ``allowed``.
    """
    one = decisions.groupBy(F.col("url").alias("_u")).agg(F.min("allowed").alias("_a"))
    out, ok = records, F.lit(True)
    for k, c in enumerate(url_cols):
        out = out.join(one.select(F.col("_u").alias(f"_u{k}"), F.col("_a").alias(f"_a{k}")), F.col(c) == F.col(f"_u{k}"), "left")
        ok = ok & (F.col(c).isNull() | F.coalesce(F.col(f"_a{k}"), F.lit(False)))
    return out.withColumn("allowed", ok).drop(*[f"_{x}{k}" for k in range(len(url_cols)) for x in "ua"])


TARGET = T.StructType([T.StructField(n, k) for n, k in (("cache_key", T.StringType()), ("locator_hash", T.StringType()), ("resolution", T.StringType()), ("text", T.StringType()), ("updated_at", T.DoubleType()))])
