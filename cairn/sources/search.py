"""Sources of search hits and pages: recorded responses as a data source, payload parsing, fetch joins."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

HIT_SCHEMA = "subquery string, rank int, title string, url string, content string, engine string, engines array<string>, positions array<int>, published_date string, score double"


def parse_hits(payload: dict, subquery: str) -> list[tuple]:
    """Rows of one response; any value of a wrong type fails the whole response."""
    out = []
    for rank, item in enumerate(payload.get("results") or []):
        if not isinstance(item, dict):
            raise ValueError("a hit is no object")
        for name in ("title", "url", "content", "engine", "publishedDate"):
            if item.get(name) is not None and not isinstance(item[name], str):
                raise ValueError(f"{name} is no text")
        score = item.get("score")
        if score is not None and (isinstance(score, bool) or not isinstance(score, (int, float)) or score != score or abs(score) == float("inf")):
            raise ValueError("score is no finite number")
        if not (item.get("url") or "").strip():
            continue
        engines = [e.strip() for e in item.get("engines") or [] if isinstance(e, str) and e.strip()][:16]
        positions = [p if isinstance(p, int) and not isinstance(p, bool) and p > 0 else None for p in item.get("positions") or []][:16]
        out.append((subquery, rank, item.get("title") or item["url"], item["url"], item.get("content"), item.get("engine") or (engines[0] if engines else None), engines, positions, item.get("publishedDate"), float(score) if score and score > 0 else 1.0 / (rank + 1)))
    return out


def parse_failures(payload: dict) -> list[tuple[str, str]]:
    """Engines that did not answer, with a reason; malformed entries are skipped."""
    return [(x[0], x[1] if len(x) > 1 and isinstance(x[1], str) and x[1] else "unresponsive") for x in payload.get("unresponsive_engines") or [] if isinstance(x, list) and x and isinstance(x[0], str)]


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]

    def partitions(self) -> list[InputPartition]:
        return [_File(str(p)) for p in sorted(Path(self.folder).glob("*.json"))]

    def read(self, partition: _File) -> Iterator[tuple]:
        path = Path(partition.path)
        try:
            yield from parse_hits(json.loads(path.read_text()), path.stem)
        except (ValueError, AttributeError):
            return


class RecordedSearch(DataSource):
    """``spark.read.format("recorded_search").load(folder)``: one partition per recorded response, named by its sub-query."""

    @classmethod
    def name(cls) -> str:
        return "recorded_search"

    def schema(self) -> str:
        return HIT_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordedSearch)


def fetch(requests: DataFrame, pages: DataFrame, key: str = "requested_url") -> DataFrame:
    """Every requested URL with its page, or the outcome ``deadline_cancelled`` where there is none; input order in ``pos``."""
    newest = pages.groupBy(key).agg(F.max_by(F.struct(*[c for c in pages.columns if c != key]), F.struct("fetched_at", "record_id")).alias("_p"))
    joined = requests.join(newest, key, "left")
    return joined.select(*requests.columns, "_p.*").withColumn("outcome", F.coalesce("outcome", F.lit("deadline_cancelled")))


def request_payload(url: Column, agent: str) -> Column:
    return F.to_json(F.struct(F.array(url).alias("urls"), F.struct(F.lit(agent).alias("user_agent"), F.lit(True).alias("check_robots_txt"), F.lit("bypass").alias("cache_mode")).alias("crawler_config")))


def allowed_headers(headers: Column, most: int = 1024) -> Column:
    """Lower-case content-type, etag, last-modified and retry-after; the first in case order of a repeated name; too long ones dropped."""
    names = ("content-type", "etag", "last-modified", "retry-after")
    entries = F.array_sort(F.map_entries(headers))
    pick = lambda n: F.try_element_at(F.filter(entries, lambda e: F.lower(e["key"]) == n), F.lit(1))["value"]
    return F.struct(*[F.when(F.octet_length(pick(n)) <= most, pick(n)).alias(n.replace("-", "_")) for n in names])
