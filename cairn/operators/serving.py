"""What surrounds a search or crawl: request limits, gates, reasons, statistics, rerank joins, response budgets."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions.url import canonical_host, host, part, port
from cairn.operators.ranking import byte_envelope

#: Fetch outcomes that a site's record keeps as its reason; all others are upstream failures.
SITE_REASONS = ("unsafe_target", "unsafe_redirect", "robots_refused", "upstream_timeout", "deadline_cancelled", "malformed_upstream_response", "rate_limited", "local_processing_failure")
#: Reasons for a response without passages, by the first stage that left nothing.
EMPTY_REASONS = ("no_results_from_discovery", "no_urls_after_selection", "all_crawls_failed", "no_chunks_after_dedup", "no_chunks_after_rerank", "no_evidence_after_quality_gate", "no_evidence_after_output_budget")
TERMINAL_STATES = ("fetched", "failed", "cancelled", "filtered")


# -- requests ----------------------------------------------------------------------------------------------------------


def limit(explicit: Column, profile: Column, default: int, most: int | None = None) -> Column:
    """The request's own value, else the profile's, else the server's; at most ``most``. Zero counts as not given."""
    value = F.coalesce(F.when(explicit != 0, explicit), F.when(profile != 0, profile), F.lit(default))
    return value if most is None else F.least(value, F.lit(most))


def planned_queries(requests: DataFrame, id_col: str, text_col: str, planner: Callable[[str], list[str]] | None = None, most: int = 3, chars: int = 500) -> DataFrame:
    """id, pos, subquery: what the planner makes of each text, cut to ``chars``; the text itself where it fails or gives nothing."""
    if planner is None:
        planned = F.array(F.col(text_col))
    else:

        @F.pandas_udf(T.ArrayType(T.StringType()))
        def run(texts: pd.Series) -> pd.Series:
            def one(text: str | None) -> list[str]:
                try:
                    return [str(q) for q in planner(text or "") or [text]]
                except Exception:  # any failure of a planner leaves the query as it is
                    return [text]

            return texts.map(one)

        planned = run(F.col(text_col))
    cut = F.transform(F.slice(planned, 1, most), lambda q: F.substring(q, 1, chars))
    return requests.select(id_col, F.posexplode(cut).alias("pos", "subquery"))


def effective_lists(operator_block: Column, request_block: Column, operator_allow: Column, request_allow: Column, allowlist_only: bool) -> tuple[Column, Column]:
    """(blocked, allowed) hosts: blocks add up; with ``allowlist_only`` a request may only narrow the operator's list. Null allows all."""
    none = F.array().cast("array<string>")
    blocked = F.array_union(F.coalesce(operator_block, none), F.coalesce(request_block, none))
    asked = F.when(F.size(request_allow) > 0, request_allow)
    if not allowlist_only:
        return blocked, asked
    own = F.coalesce(operator_allow, none)
    return blocked, F.when(asked.isNull(), own).otherwise(F.array_intersect(asked, own))


def matches_any(h: Column, names: Column) -> Column:
    """Whether a host is one of ``names`` or below one."""
    return F.exists(names, lambda n: (n != "") & ((h == n) | h.endswith(F.concat(F.lit("."), n))))


def operator_allows(url: str, blocked: Column, allowed: Column, allowlist_only: bool) -> Column:
    """The operator's own gate for one URL: a host, not blocked and, if lists are closed, allowed."""
    h = host(url)
    canonical = lambda names: F.transform(names, canonical_host)
    ok = (h != "") & ~matches_any(h, canonical(blocked))
    return ok & matches_any(h, canonical(allowed)) if allowlist_only else ok


def unsupported(requested: Column, supported: tuple[str, ...]) -> Column:
    """Requested capabilities that are not supported, in order; any of them fails all URLs of the request."""
    return F.array_sort(F.array_except(F.coalesce(requested, F.array().cast("array<string>")), F.array(*[F.lit(s) for s in supported])))


def sitemap_allowed(url: str, seed: str, include_subdomains: bool) -> Column:
    """A sitemap on the seed's origin or, if wanted, on a subdomain of its host."""
    s = F.lit(seed)
    origin = lambda u: F.concat_ws("|", part(u, 1), host(u), F.when(port(u) == "", F.when(part(u, 1) == "http", "80").otherwise("443")).otherwise(port(u)))
    below = F.lit(include_subdomains) & (host(s) != "") & host(url).endswith(F.concat(F.lit("."), host(s)))
    return (part(url, 1) != "") & (host(url) != "") & ((origin(url) == origin(s)) | below)


# -- outcomes and statistics -------------------------------------------------------------------------------------------


def site_reason(outcome: Column, is_seed: Column) -> Column:
    return F.when(is_seed & (outcome == "unsafe_target"), "unsafe_seed").when(outcome.isin(*SITE_REASONS), outcome).otherwise("upstream_failure")


def empty_reason(*counts: Column) -> Column:
    """Why nothing came out: the first of the seven stage counts (hits to kept passages) that is 0; null if none is."""
    reason = F.when(F.coalesce(counts[0], F.lit(0)) == 0, EMPTY_REASONS[0])
    for n, name in zip(counts[1:], EMPTY_REASONS[1:], strict=True):
        reason = reason.when(F.coalesce(n, F.lit(0)) == 0, name)
    return reason


def engine_failures(rows: DataFrame, engine_col: str, reason_col: str, top: int = 32) -> DataFrame:
    """Distinct (engine, reason), sorted, the first ``top``: a report; names are combined before the shuffle."""
    return rows.filter(F.col(engine_col).isNotNull() & F.col(reason_col).isNotNull()).select(engine_col, reason_col).distinct().orderBy(engine_col, reason_col).limit(top)


def fetch_stats(outcomes: DataFrame, keys: list[str], outcome: Column, state: Column) -> DataFrame:
    """Succeeded, failed and cache states per key."""
    states = [F.count_if(state == s).alias(f"n_{s}") for s in ("fresh", "stale", "refresh")]
    return outcomes.groupBy(*keys).agg(F.count_if(outcome == "content").alias("succeeded"), F.count_if(F.coalesce(outcome != "content", F.lit(True))).alias("failed"), *states)


def site_outcome(records: DataFrame, keys: list[str], over_limit: Column, failed: Column) -> DataFrame:
    """limit_reached before partial before completed."""
    flags = records.groupBy(*keys).agg(F.bool_or(F.coalesce(over_limit, F.lit(False))).alias("_l"), F.bool_or(F.coalesce(failed, F.lit(False))).alias("_f"))
    return flags.select(*keys, F.when(F.col("_l"), "limit_reached").when(F.col("_f"), "partial").otherwise("completed").alias("site_outcome"))


def degraded(chunks: DataFrame, keys: list[str], flag: Column, strategy_col: str, order_col: str) -> DataFrame:
    """Whether any chunk is degraded, and the strategy of the first one."""
    return chunks.groupBy(*keys).agg(F.bool_or(F.coalesce(flag, F.lit(False))).alias("degraded"), F.min_by(strategy_col, order_col).alias("strategy"))


def marked(states: Column, state: str) -> Column:
    """A record's states with a terminal one added, unless its last one is terminal already."""
    return F.when(F.coalesce(F.element_at(states, -1).isin(*TERMINAL_STATES), F.lit(False)), states).otherwise(F.array_append(states, F.lit(state)))


def prepared_seeds(seeds: DataFrame, pages: DataFrame, url_col: str, safe: Column, robots: DataFrame, agent_allowed: str = "allowed") -> DataFrame:
    """Per seed its effective URL after redirects, and why a crawl from it cannot start (null if it can).

    ``pages`` has ``requested_url``, ``final_url``, ``outcome``; ``robots`` has ``url`` and the decision. One page per URL.
    """
    fetched = pages.groupBy(F.col("requested_url").alias("_u")).agg(F.max_by(F.struct("final_url", "outcome"), F.struct("fetched_at", "record_id")).alias("_p"))
    joined = seeds.withColumn("_safe", safe).join(fetched, F.col(url_col) == F.col("_u"), "left")
    decided = robots.groupBy(F.col("url").alias("_r")).agg(F.min(agent_allowed).alias("_ok"))
    joined = joined.join(decided, F.col(url_col) == F.col("_r"), "left")
    reason = (
        F.when(~F.coalesce(F.col("_safe"), F.lit(False)), "unsafe_seed")
        .when(F.col("_p").isNull(), "deadline_cancelled")
        .when(F.col("_p.outcome") != "content", site_reason(F.col("_p.outcome"), F.lit(True)))
        .when(~F.coalesce(F.col("_ok"), F.lit(True)), "robots_refused")
    )
    return joined.withColumn("effective_url", F.coalesce(F.col("_p.final_url"), F.col(url_col))).withColumn("reason", reason).drop("_safe", "_u", "_p", "_r", "_ok")


def merged_sources(rows: DataFrame, key_col: str, source_col: str, depth_col: str) -> DataFrame:
    """One record per key: its least depth and the sorted sources it came from."""
    return rows.groupBy(key_col).agg(F.min(depth_col).alias("depth"), F.array_join(F.array_sort(F.collect_set(source_col)), ",").alias("sources"))


# -- rerank ------------------------------------------------------------------------------------------------------------


def numbered(chunks: DataFrame, group_col: str, order: list[Column | str], batch: int) -> DataFrame:
    """Adds ``batch`` and ``index`` within it, in order."""
    n = F.row_number().over(Window.partitionBy(group_col).orderBy(*order)) - 1
    return chunks.withColumn("_n", n).withColumn("batch", F.floor(F.col("_n") / batch).cast("int")).withColumn("index", (F.col("_n") % batch).cast("int")).drop("_n")


def rerank_join(chunks: DataFrame, responses: DataFrame, group_col: str, order_col: str) -> DataFrame:
    """Chunks (with ``batch`` and ``index``) with the scores that a reranker returned for their places.

    Indexes out of range meet nothing, of repeated ones the first by ``order_col`` counts; chunks without a score get the
    group's lowest score minus one; a group without any score keeps null. ``scored`` tells which were returned.
    """
    first = responses.groupBy(group_col, "batch", "index").agg(F.min_by("score", order_col).alias("score"))
    low = chunks.select(group_col, "batch", "index").join(first, [group_col, "batch", "index"]).groupBy(group_col).agg(F.min("score").alias("_low"))
    joined = chunks.drop("score").join(first, [group_col, "batch", "index"], "left").join(low, group_col, "left")
    return joined.withColumn("scored", F.col("score").isNotNull()).withColumn("score", F.coalesce("score", F.col("_low") - 1)).drop("_low")


def reranked(chunks: DataFrame, group_col: str, query: str, text_col: str, order: list[Column | str], scorer: Callable[[str, list[str]], list[float]], batch: int = 32) -> DataFrame:
    """Scores of a function over batches of texts; a batch that fails is scored by the floor, as ``rerank_join`` has it."""
    rows = numbered(chunks, group_col, order, batch)
    slim = rows.select(F.col(group_col).alias("_g"), "batch", "index", F.col(text_col).alias("_t"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("index")
        try:
            scores = [float(s) for s in scorer(query, pdf["_t"].fillna("").tolist())]
        except Exception:  # any failure of a scorer loses its batch only
            scores = []
        pdf = pdf.iloc[: len(scores)]
        return pd.DataFrame({"_g": pdf["_g"], "batch": pdf["batch"], "index": pdf["index"], "score": scores[: len(pdf)], "position": range(len(pdf))})

    schema = T.StructType([slim.schema["_g"], T.StructField("batch", T.IntegerType()), T.StructField("index", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("position", T.IntegerType())])
    responses = slim.groupBy("_g", "batch").applyInPandas(run, schema).withColumnRenamed("_g", group_col)
    return rerank_join(rows, responses, group_col, "position")


# -- responses ---------------------------------------------------------------------------------------------------------


def diagnostics(decisions: DataFrame, group_col: str, order: list[str], most: int = 50, most_bytes: int = 65_536) -> DataFrame:
    """Decisions with ``kept``: selected ones first, then the others, as far as items and bytes of the report go.

    Reads ``selected``, ``url``, ``title``, ``engine``, ``selection_reason``, ``filtered_reason``; needs no group in memory.
    """
    wire = F.to_json(F.struct("url", "title", "engine", "selected", "selection_reason", "filtered_reason"))
    sized = decisions.withColumn("_later", (~F.col("selected")).cast("int")).withColumn("n_bytes", F.octet_length(wire))
    return byte_envelope(sized, group_col, ["_later", *order], "n_bytes", most_bytes, most_bytes, most, 2, 1, "kept").drop("_later")


def omissions(reported: DataFrame, group_col: str) -> DataFrame:
    """How many decisions the report left out, per reason."""
    reason = F.coalesce("filtered_reason", F.lit("selected_over_budget")).alias("reason")
    return reported.filter(~F.col("kept")).groupBy(group_col, reason).agg(F.count("*").alias("n"))


def record_budget(records: DataFrame, group_col: str, order: list[str], body: Column, share: int) -> DataFrame:
    """Records with ``kept`` as far as their JSON, one byte between them, fits ``share`` bytes; others are skipped one by one."""
    return byte_envelope(records.withColumn("n_bytes", F.octet_length(body) + 1), group_col, order, "n_bytes", share, share, None, 2, 0, "kept")


def fitted_text(text: str, most_bytes: int) -> str | None:
    """The longest prefix whose JSON string has at most ``most_bytes`` bytes; escapes make its size uneven. None if none fits."""
    size = lambda t: len(json.dumps(t, ensure_ascii=False).encode("utf-8", "surrogatepass"))
    if size(text) <= most_bytes:
        return text
    low, high = 0, len(text)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if size(text[:mid]) <= most_bytes else (low, mid - 1)
    return text[:low] or None


def fit_text(most_bytes: int) -> Callable:
    """Arrow UDF of ``fitted_text``."""

    @F.pandas_udf(T.StringType())
    def fit(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: None if t is None else fitted_text(t, most_bytes))

    return fit


def shrunk(value: dict[str, list], most_bytes: int) -> tuple[dict[str, list], int]:
    """Lists trimmed from the end, the largest in bytes first, until the JSON fits; and the number of items left out."""
    size = lambda v: len(json.dumps(v, ensure_ascii=False).encode("utf-8", "surrogatepass"))
    out, omitted = {k: list(v) for k, v in value.items()}, 0
    sizes = {k: size(v) for k, v in out.items()}
    while size(out) > most_bytes and any(out.values()):
        name = max((k for k in out if out[k]), key=lambda k: (sizes[k], k))
        out[name].pop()
        sizes[name] = size(out[name])
        omitted += 1
    return out, omitted


def shrink_json(most_bytes: int) -> Callable:
    """Arrow UDF: a JSON object of lists as (json, omitted) within ``most_bytes``; other texts are null."""

    @F.pandas_udf(T.StructType([T.StructField("json", T.StringType()), T.StructField("omitted", T.IntegerType())]))
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            try:
                value = json.loads(text)
                fits = isinstance(value, dict) and all(isinstance(v, list) for v in value.values())
            except (TypeError, ValueError, RecursionError):
                fits = False
            out, omitted = shrunk(value, most_bytes) if fits else (None, None)
            rows.append((None if out is None else json.dumps(out, ensure_ascii=False), omitted))
        return pd.DataFrame(rows, columns=["json", "omitted"])

    return run


def bounded_json(text: str | None, most_items: int = 32, most_bytes: int = 4096, most_depth: int = 8) -> str | None:
    """A JSON object with sorted keys, copied value by value until items or bytes run out; null if the text is no object.

    The copy ends at the first value that does not fit; values below ``most_depth`` are left out.
    """
    try:
        source = json.loads(text) if text is not None else None
    except (ValueError, RecursionError):
        return None
    if not isinstance(source, dict):
        return None
    copy: dict = {}
    left = most_items
    ended = False

    def add(value: object, target: dict | list, key: str | None, depth: int) -> None:
        nonlocal left, ended
        nested = isinstance(value, (dict, list))
        if ended or left == 0 or nested and depth >= most_depth:
            return
        held = type(value)() if nested else value
        if key is None:
            target.append(held)
        else:
            target[key] = held
        if len(json.dumps(copy, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass")) > most_bytes:
            target.pop() if key is None else target.pop(key)
            ended = True
            return
        left -= 1
        children = [(k, value[k]) for k in sorted(value)] if isinstance(value, dict) else [(None, x) for x in value] if nested else []
        for k, x in children:
            add(x, held, k, depth + 1)

    for k in sorted(source):
        add(source[k], copy, k, 1)
    return json.dumps(copy, ensure_ascii=False, separators=(",", ":"))


def bounded_copy(most_items: int, most_bytes: int) -> Callable:
    """Arrow UDF of ``bounded_json``."""

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: bounded_json(t, most_items, most_bytes))

    return run


def in_request_order(results: DataFrame, requests: DataFrame, id_col: str, urls_col: str, url_col: str) -> DataFrame:
    """Results with ``pos``, the place of their URL in the request, in that order within each request."""
    places = requests.select(id_col, F.posexplode(urls_col).alias("pos", url_col)).groupBy(id_col, url_col).agg(F.min("pos").alias("pos"))
    return results.join(places, [id_col, url_col]).orderBy(id_col, "pos")


def replaced(items: Column, field: str, name: str, new: Column) -> Column:
    """An array of structs with the elements whose ``field`` is ``name`` replaced."""
    return F.transform(items, lambda x: F.when(x[field] == name, new).otherwise(x))
