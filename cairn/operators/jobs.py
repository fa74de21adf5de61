"""Durable crawl jobs as tables: idempotent claims, result appends, failures, counters, keyset pages, expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ("completed", "partial", "failed", "cancelled", "expired")


def claims(requests: DataFrame, scope_col: str, key_col: str, fingerprint_col: str, order: list[str]) -> DataFrame:
    """The first request of a (scope, idempotency key) is ``created``; equal later ones are ``replayed``, others ``conflict``."""
    struct = F.struct(*[F.col(c) for c in order], F.col(fingerprint_col).alias("_f"))
    first = requests.groupBy(F.col(scope_col).alias("_s"), F.col(key_col).alias("_k")).agg(F.min(struct).alias("_first"))
    same = F.col(scope_col).eqNullSafe(F.col("_s")) & F.col(key_col).eqNullSafe(F.col("_k"))
    is_first = F.struct(*[F.col(c) for c in order]) == F.struct(*[F.col("_first")[c].alias(c) for c in order])
    outcome = F.when(is_first, "created").when(F.col(fingerprint_col).eqNullSafe(F.col("_first._f")), "replayed").otherwise("conflict")
    return requests.join(first, same).withColumn("claim", outcome).drop("_s", "_k", "_first")


def append_results(results: DataFrame, job_col: str, key_col: str, order: list[str]) -> DataFrame:
    """Results of each job without repeated keys (the first arrival counts), numbered in arrival order."""
    cols = [c for c in results.columns if c not in (job_col, key_col)]
    firsts = results.groupBy(job_col, key_col).agg(F.min_by(F.struct(*cols), F.struct(*[F.col(c) for c in order])).alias("_r")).select(job_col, key_col, "_r.*")
    return firsts.withColumn("ordinal", F.row_number().over(Window.partitionBy(job_col).orderBy(*order)))


def open_failures(failures: DataFrame, results: DataFrame, job_col: str, key_col: str, reason_col: str, most: int = 16) -> DataFrame:
    """Per job the failures without a result: their number and up to ``most`` distinct reasons, smallest first."""
    left = failures.join(results.select(job_col, key_col).distinct(), [job_col, key_col], "left_anti")
    reasons = left.select(job_col, reason_col).distinct().withColumn("_n", F.row_number().over(Window.partitionBy(job_col).orderBy(reason_col))).filter(F.col("_n") <= most)
    listed = reasons.groupBy(job_col).agg(F.array_sort(F.collect_list(reason_col)).alias("reasons"))
    return left.groupBy(job_col).agg(F.count_distinct(key_col).alias("n_failed")).join(listed, job_col)


def counters(events: DataFrame, job_col: str, key_col: str, ok: Column) -> DataFrame:
    """processed, succeeded and failed keys of each job; a key with any success is no failure."""
    per_key = events.groupBy(job_col, key_col).agg(F.max(ok.cast("int")).alias("_ok"))
    out = per_key.groupBy(job_col).agg(F.count("*").alias("processed"), F.sum("_ok").alias("succeeded"), F.sum(1 - F.col("_ok")).alias("failed"))
    return out.withColumn("state", F.when(F.col("failed") == 0, "completed").when(F.col("succeeded") > 0, "partial").otherwise("failed"))


def result_page(results: DataFrame, job_col: str, after: int, max_items: int, max_bytes: int, bytes_col: str) -> DataFrame:
    """The next page of each job after an ordinal: at most ``max_items`` rows, stopping before the first that overflows."""
    page = results.filter(F.col("ordinal") > after).filter(F.col("ordinal") <= after + max_items)
    total = F.sum(bytes_col).over(Window.partitionBy(job_col).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0))
    return page.withColumn("running_bytes", total).filter(F.col("running_bytes") <= max_bytes)


def expire(jobs: DataFrame, now: Column, deadline_col: str, state_col: str, tombstone_seconds: float) -> DataFrame:
    """Terminal jobs past their deadline become ``expired``; they disappear after the tombstone time."""
    due = F.col(state_col).isin(*TERMINAL) & (F.col(deadline_col) <= now)
    kept = jobs.filter(~due | (F.col(deadline_col) + tombstone_seconds > now) | F.col(deadline_col).isNull())
    return kept.withColumn(state_col, F.when(due, "expired").otherwise(F.col(state_col)))


def final_state(events: DataFrame, job_col: str, state_col: str, order: list[str]) -> DataFrame:
    """The first terminal state wins; a requested cancellation before it makes it ``cancelled``."""
    terminal = events.filter(F.col(state_col).isin(*TERMINAL)).groupBy(job_col).agg(F.min(F.struct(*order, state_col)).alias("t"))
    cancel = events.filter(F.col(state_col) == "cancel_requested").groupBy(job_col).agg(F.min(F.struct(*order)).alias("c"))
    before = F.col("c").isNotNull() & (F.col("c") < F.struct(*[F.col("t")[c].alias(c) for c in order]))
    return terminal.join(cancel, job_col, "left").select(job_col, F.when(before, "cancelled").otherwise(F.col("t")[state_col]).alias("final_state"))


def state_counts(records: DataFrame, states_col: str) -> DataFrame:
    """A record counts in every state it passed."""
    return records.select(F.explode(states_col).alias("state")).groupBy("state").agg(F.count("*").alias("n"))


def next_queued(jobs: DataFrame, scope_col: str, order: list[str], id_col: str) -> DataFrame:
    """The first queued job of each scope, as an aggregation."""
    return jobs.groupBy(scope_col).agg(F.min_by(id_col, F.struct(*order)).alias(id_col))


def retries(failures: DataFrame, job_col: str, order: list[Column], base: float, most: float) -> DataFrame:
    """Adds ``attempt`` and ``wait``: the pause doubles from ``base`` seconds with every attempt, up to ``most``."""
    attempt = F.row_number().over(Window.partitionBy(job_col).orderBy(*order))
    return failures.withColumn("attempt", attempt).withColumn("wait", F.least(F.lit(float(most)), base * F.pow(F.lit(2), F.least(F.col("attempt") - 1, F.lit(20)))))


def read_jobs(jobs: DataFrame, results: DataFrame, job_col: str, result_col: str, at_col: str, deadline: Column) -> DataFrame:
    """Jobs with their number of results and last arrival, expired ones told first."""
    counts = results.groupBy(job_col).agg(F.count(result_col).alias("n_results"), F.max(at_col).alias("last_at"))
    joined = jobs.join(counts, job_col, "left").withColumn("n_results", F.coalesce("n_results", F.lit(0)))
    return joined.withColumn("state", F.when(F.col("last_at") < deadline, "expired").otherwise("running"))
