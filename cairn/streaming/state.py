"""Keyed state with processing over time: cache freshness, host back-off, watch history.

Each operator keeps one small record per key, so its state grows with keys, not with events; timers drop keys after their
retention.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _rows(batches: Iterator[pd.DataFrame], order: list[str]) -> list[dict]:
    parts = [b for b in batches if len(b)]
    return pd.concat(parts).sort_values(order, kind="stable").to_dict("records") if parts else []


def host_backoff(events: DataFrame, most: int = 300) -> DataFrame:
    """Refusals in a row per host and the delay they call for. ``events``: host, ts, event_id, status_code."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (failures,) = state.get if state.exists else (0,)
        out = []
        for r in _rows(batches, ["ts", "event_id"]):
            code = r["status_code"]
            failures = failures + 1 if code in (403, 429) else 0 if code is not None and 200 <= code < 400 else failures
            out.append((key[0], int(r["event_id"]), failures, min(most, 2 ** min(failures, 10)) if code in (403, 429) else 0))
        state.update((failures,))
        yield pd.DataFrame(out, columns=["host", "event_id", "failures", "delay"])

    return events.groupBy("host").applyInPandasWithState(step, "host string, event_id long, failures int, delay int", "failures int", "append", GroupStateTimeout.NoTimeout)


def watch_history(events: DataFrame) -> DataFrame:
    """Value changes per watched key; the baseline survives observations without a value. ``events``: key, ts, event_id, value."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (base,) = state.get if state.exists else (None,)
        out = []
        for r in _rows(batches, ["ts", "event_id"]):
            value = r["value"] if isinstance(r["value"], str) else None
            out.append((key[0], int(r["event_id"]), base, base is not None and value is not None and value != base))
            base = value if value is not None else base
        state.update((base,))
        yield pd.DataFrame(out, columns=["key", "event_id", "baseline", "fired"])

    return events.groupBy("key").applyInPandasWithState(step, "key string, event_id long, baseline string, fired boolean", "base string", "append", GroupStateTimeout.NoTimeout)


def cache_reads(events: DataFrame, ttl: float, stale: float, retention: float) -> DataFrame:
    """What each request finds in the cache: hit, stale or refresh. ``events``: key, at (seconds), event_id.

    A refresh renews the expiry; retention counts from the refresh and is not prolonged by reads. Keys idle beyond their
    retention are dropped by a timer.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=["key", "event_id", "state"])
            return
        expires, retained = state.get if state.exists else (-1.0, -1.0)
        out = []
        for r in _rows(batches, ["at", "event_id"]):
            now = float(r["at"])
            found = "refresh" if now >= retained or now >= expires + stale else "fresh" if now < expires else "stale"
            if found == "refresh":
                expires, retained = now + ttl, now + retention
            out.append((key[0], int(r["event_id"]), found))
        state.update((expires, retained))
        state.setTimeoutDuration(int(retention * 1000))
        yield pd.DataFrame(out, columns=["key", "event_id", "state"])

    return events.groupBy("key").applyInPandasWithState(step, "key string, event_id long, state string", "expires double, retained double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def upsert_batches(stream: DataFrame, path: str, key_col: str, at_col: str, id_col: str):
    """Sink: per micro-batch the newest row of each key, in a folder named by the batch id, so a repeated batch replaces itself."""
    from cairn.operators.pages import latest_versions

    def write(batch: DataFrame, batch_id: int) -> None:
        latest_versions(batch, key_col, at_col, id_col).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write)


def write_pages_and_targets(pages: DataFrame, targets: DataFrame, path: str, batch_id: int, key_col: str = "cache_key", at_col: str = "at", id_col: str = "id") -> None:
    """Both tables of one micro-batch in folders of the batch id: a repeated batch replaces both, so they stay together."""
    from cairn.operators.pages import latest_versions

    latest_versions(pages, key_col, at_col, id_col).write.mode("overwrite").parquet(f"{path}/pages/batch={batch_id}")
    targets.write.mode("overwrite").parquet(f"{path}/targets/batch={batch_id}")
