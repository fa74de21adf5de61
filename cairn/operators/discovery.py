"""Search hits: normalising, merging by URL, domain policy, diverse selection."""

from __future__ import annotations

import math
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions.texts import overlap
from cairn.functions.url import host, host_suffixes, normalize_url

MAX_ENGINES = 16


def normal_hits(hits: DataFrame, rank: Column) -> DataFrame:
    """Title falls back to the URL, engine to the first of ``engines``, a missing or non-positive score to 1/(rank+1).

    Adds ``contributions``: engine and position pairs, the first of each engine.
    """
    engines = F.slice(F.filter(F.transform(F.coalesce("engines", F.array().cast("array<string>")), lambda e: F.trim(e)), lambda e: e != ""), 1, MAX_ENGINES)
    named = hits.filter(F.coalesce(F.trim("url"), F.lit("")) != "").withColumn("_engines", engines)
    engine = F.coalesce(F.when(F.trim("engine") != "", F.trim("engine")), F.try_element_at("_engines", F.lit(1)))
    score = F.when((F.col("score") > 0) & ~F.isnan("score"), F.col("score")).otherwise(1.0 / (rank + 1))
    all_engines = F.when(F.size("_engines") > 0, F.col("_engines")).when(engine.isNotNull(), F.array(engine)).otherwise(F.array().cast("array<string>"))
    distinct = F.array_distinct("_all")
    pairs = F.transform(distinct, lambda e: F.struct(e.alias("engine"), F.try_element_at(F.col("positions"), F.array_position("_all", e).cast("int")).alias("position")))
    return (
        named.withColumn("title", F.coalesce(F.when(F.trim("title") != "", F.col("title")), F.col("url")))
        .withColumn("_all", all_engines)
        .withColumn("engine", engine)
        .withColumn("score", score)
        .withColumn("contributions", F.transform(pairs, lambda p: F.struct(p["engine"].alias("engine"), F.when(p["position"] > 0, p["position"]).alias("position"))))
        .drop("_engines", "_all")
    )


def merge_hits(hits: DataFrame, id_col: str, set_col: str) -> DataFrame:
    """One row per normalised URL: the best hit (highest score, then lowest id) and all engine contributions.

    Both sides are aggregations, so hot URLs are combined before the shuffle.
    """
    keyed = hits.withColumn("key", normalize_url("url"))
    best = keyed.groupBy("key").agg(
        F.max_by(F.struct(id_col, "title", "url", "engine", "score"), F.struct("score", -F.col(id_col))).alias("b"),
        F.count("*").alias("n_hits"),
    )
    parts = keyed.select("key", F.col(set_col).alias("subquery"), "score", F.explode_outer("contributions").alias("c"))
    votes = parts.filter("c IS NOT NULL").groupBy("key", "subquery", F.col("c.engine").alias("engine"), F.col("c.position").alias("position")).agg(F.max("score").alias("score"))
    counted = votes.groupBy("key").agg(F.count("*").alias("n_contributions"), F.count_distinct("engine").alias("n_engines"), F.max("score").alias("best_vote"))
    return best.join(counted, "key", "left").select("key", "b.*", "n_hits", F.coalesce("n_contributions", F.lit(0)).alias("n_contributions"), F.coalesce("n_engines", F.lit(0)).alias("n_engines"))


def merged_candidates(hits: DataFrame, id_col: str) -> DataFrame:
    """One hit per normalised URL (highest score, then lowest id) with the engines of all its hits as ``contributions``."""
    best = F.max_by(F.struct(id_col, "title", "url", "content", "engine", "score"), F.struct("score", -F.col(id_col)))
    engines = F.array_distinct(F.flatten(F.collect_set(F.transform("contributions", lambda c: c["engine"]))))  # as many as there are engines
    rows = hits.groupBy(normalize_url("url").alias("_key")).agg(best.alias("b"), engines.alias("_e"))
    pairs = F.transform("_e", lambda e: F.struct(e.alias("engine"), F.lit(None).cast("int").alias("position")))
    return rows.select("b.*", pairs.alias("contributions"))


def engine_contributions(hits: DataFrame, top: int = 32) -> DataFrame:
    """Contributions per engine before merging, most first."""
    counts = hits.select(F.explode("contributions").alias("c")).groupBy(F.col("c.engine").alias("engine")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "engine").limit(top)


def domain_decisions(hits: DataFrame, blocked: DataFrame | None, allowed: DataFrame | None, url_col: str = "url") -> DataFrame:
    """Adds ``host`` and ``filtered_reason`` (null for candidates). List tables have one column ``host``.

    Suffix tests are equi-joins on the host's parent domains, deduplicated before the join back.
    """
    with_host = hits.withColumn("_h", host(url_col))
    suffixes = with_host.select("_h").distinct().select("_h", F.explode(host_suffixes(F.col("_h"))).alias("_s"))

    def listed(names: DataFrame, flag: str) -> DataFrame:
        return suffixes.join(names.select(F.lower("host").alias("_s")).distinct(), "_s", "left_semi").select("_h").distinct().withColumn(flag, F.lit(True))

    out = with_host
    if blocked is not None:
        out = out.join(listed(blocked, "_b"), "_h", "left")
    else:
        out = out.withColumn("_b", F.lit(None).cast("boolean"))
    if allowed is not None:
        out = out.join(listed(allowed, "_a"), "_h", "left")
    else:
        out = out.withColumn("_a", F.lit(True))
    reason = F.when(F.col("_h") == "", "invalid_host").when(F.col("_b"), "blocked_domain").when(F.col("_a").isNull(), "outside_allowlist")
    return out.withColumn("filtered_reason", reason).drop("_b", "_a", "host").withColumnRenamed("_h", "host")


def attach_published(pages: DataFrame, url_col: str, hits: DataFrame, id_col: str, published_col: str) -> DataFrame:
    """Pages with the first hit of their URL and its publication text, null where there is none. One hit per URL is joined."""
    first = hits.groupBy(normalize_url("url").alias("_key")).agg(F.min(F.struct(id_col, published_col)).alias("_d"))
    return pages.withColumn("_key", normalize_url(url_col)).join(first, "_key", "left").select(*pages.columns, "_d.*")


def domain_limit(max_urls: int, allowed: int | None = None) -> int:
    """How many URLs one host may take: all if a single host is allowed, one for tiny requests, else a third up to 3."""
    if allowed is not None and allowed <= 1:
        return max_urls
    return 1 if max_urls <= 2 else min(3, max(1, math.ceil(max_urls / 3)))


def candidate_order(lexical: str = "lexical_score") -> list[Column]:
    return [F.desc(F.col("score") + 0.25 * F.col(lexical)), F.desc("score"), F.col("url")]


def with_lexical(hits: DataFrame, query: Column) -> DataFrame:
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")), F.coalesce("url", F.lit("")))
    return hits.withColumn("lexical_score", overlap(query, text))


def choose(rows: Iterable[tuple], max_urls: int, per_host: int) -> dict[int, str]:
    """Greedy choice over ordered (url, host, engines): new engine, then new host, then score; index -> reason."""
    rows = list(rows)
    picked: dict[int, str] = {}
    urls: set[str] = set()
    hosts: dict[str, int] = {}
    engines: set[str] = set()
    wishes = (("engine_diversity", lambda r: bool(r[2] - engines)), ("domain_diversity", lambda r: r[1] not in hosts), ("score", lambda r: True))
    for reason, wanted in wishes:
        for k, r in enumerate(rows):
            if len(picked) >= max_urls:
                return picked
            if wanted(r) and r[0] not in urls and hosts.get(r[1], 0) < per_host:
                picked[k] = reason
                urls.add(r[0])
                hosts[r[1]] = hosts.get(r[1], 0) + 1
                engines |= r[2]
    return picked


def select_urls(hits: DataFrame, group_col: str, id_col: str, max_urls: int = 6, per_host: int | None = None, allowed: int | None = None) -> DataFrame:
    """The chosen hits of each query with the reason of their choice.

    Without ``per_host``, a query whose hits lie on one host may take ``max_urls`` from it, others ``domain_limit``, where
    ``allowed`` is the number of hosts on the allow list, if there is one.

    The greedy choice runs on a bounded share of each group that holds every row it can choose, so leaving out the others
    changes nothing. A row is chosen for a new engine only if all earlier rows with that engine are of a full host or a
    chosen URL. Hence, counting each URL once per engine, it is among the first ``most`` of its host and engine, and of
    these among the first ``max_urls * (most + 1)`` of its engine, ``most`` being all that one host may take. The same holds
    for the choice by score with any engine (``_e`` null); one for a new host is the first row of one of the first
    ``max_urls`` hosts. A URL has one host.
    """
    cap = per_host or domain_limit(max_urls, allowed)
    most = per_host or max_urls
    order = [*candidate_order(), F.col(id_col)]
    first = lambda *keys: F.row_number().over(Window.partitionBy(group_col, *keys).orderBy(*order))
    engines = F.array_distinct(F.array_compact(F.concat(F.transform("contributions", lambda c: c["engine"]), F.array("engine"))))
    slim = hits.select(group_col, id_col, "url", "host", engines.alias("_engines"), "score", "lexical_score")
    by_engine = slim.withColumn("_e", F.explode(F.concat(F.coalesce("_engines", F.array().cast("array<string>")), F.array(F.lit(None).cast("string")))))
    by_engine = by_engine.withColumn("_u", first("host", "url", "_e")).filter("_u = 1").drop("_u")
    of_host = by_engine.withColumn("_in_host", first("host", "_e")).filter(F.col("_in_host") <= most)
    near = of_host.withColumn("_r", first("_e")).filter(F.col("_r") <= max_urls * (most + 1))
    near_host = of_host.filter("_e IS NULL AND _in_host = 1").withColumn("_r", first()).filter(F.col("_r") <= 2 * max_urls)
    few = near.unionByName(near_host).drop("_e", "_in_host", "_r").dropDuplicates([group_col, id_col])

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_k=-(pdf["score"] + 0.25 * pdf["lexical_score"]), _s=-pdf["score"]).sort_values(["_k", "_s", "url", id_col], kind="stable")
        limit = most if pdf["host"].nunique(dropna=False) == 1 else cap
        found = choose(((u, h, set(() if e is None else e)) for u, h, e in zip(pdf["url"], pdf["host"], pdf["_engines"], strict=True)), max_urls, limit)
        out = pdf.iloc[list(found)][[group_col, id_col, "url", "host"]].copy()
        out["selection_reason"] = list(found.values())
        out["choice"] = range(1, len(out) + 1)
        return out

    schema = T.StructType([few.schema[group_col], few.schema[id_col], few.schema["url"], few.schema["host"], T.StructField("selection_reason", T.StringType()), T.StructField("choice", T.IntegerType())])
    return few.groupBy(group_col).applyInPandas(pick, schema)


def selection_decisions(hits: DataFrame, group_col: str, id_col: str, max_urls: int = 6, allowed: int | None = None) -> DataFrame:
    """All candidates with ``selected``, ``selection_reason`` and ``filtered_reason`` (``domain_cap`` or ``rank_cap``).

    Other hits of a selected URL are no decisions of their own and are left out. What is selected is counted per host
    before it is joined, so the joins carry a few rows per query.
    """
    chosen = select_urls(hits, group_col, id_col, max_urls, allowed=allowed).select(group_col, id_col, "url", "host", "selection_reason")
    key = F.col(group_col).eqNullSafe(F.col("_g"))
    own = chosen.select(F.col(group_col).alias("_g"), F.col(id_col).alias("_id"), "selection_reason")
    taken = chosen.select(F.col(group_col).alias("_g"), F.col("url").alias("_url")).distinct()
    full = chosen.groupBy(F.col(group_col).alias("_g"), F.col("host").alias("_host")).agg(F.count("*").alias("_taken"))
    hosts = hits.groupBy(F.col(group_col).alias("_g")).agg(F.when(F.count_distinct("host") > 1, domain_limit(max_urls, allowed)).otherwise(max_urls).alias("_limit"))
    rows = hits.join(own, key & (F.col(id_col) == F.col("_id")), "left").drop("_g", "_id")
    marked = taken.withColumn("_again", F.lit(True))
    rows = rows.join(marked, key & (F.col("url") == F.col("_url")), "left").filter("selection_reason IS NOT NULL OR _again IS NULL").drop("_g", "_url", "_again")
    rows = rows.join(full, key & F.col("host").eqNullSafe(F.col("_host")), "left").drop("_g", "_host")
    rows = rows.join(hosts, key).drop("_g")
    reason = F.when(F.col("selection_reason").isNull(), F.when(F.coalesce("_taken", F.lit(0)) >= F.col("_limit"), "domain_cap").otherwise("rank_cap"))
    return rows.withColumn("selected", F.col("selection_reason").isNotNull()).withColumn("filtered_reason", reason).drop("_taken", "_limit")
