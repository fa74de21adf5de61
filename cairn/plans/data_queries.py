"""Queries of the general data problems (timestamps, nested records)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import nested, timestamps
from cairn.session import load_table

TIME_TEXTS = (
    ("discovery_results", "result_id", "published_date"),
    ("validator_observations", "observation_id", "last_modified"),
    ("sitemap_entries", "entry_id", "modified_at"),
)


def _time_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        load_table(spark, sf_dir, table).select(F.lit(table).alias("table_name"), F.col(key).alias("row_id"), "host", F.col(text).alias("time_text"))
        for table, key, text in TIME_TEXTS
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = timestamps.unambiguous_instants(_time_rows(spark, sf_dir), load_table(spark, sf_dir, "hosts"), ["table_name", "host"], "row_id", "time_text")
    return found.select("table_name", "row_id", "utc")


def p3_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose digits allow two orders, decided by Viterbi alone: the order that ``hosts`` knows is withheld."""
    hosts = load_table(spark, sf_dir, "hosts").withColumn("date_order", F.lit(None).cast("string"))
    found = timestamps.resolved_instants(_time_rows(spark, sf_dir), hosts, ["table_name", "host"], "row_id", "time_text")
    return found.select("table_name", "row_id", "utc", "n_readings")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.crawl_fields(load_table(spark, sf_dir, "crawl_results"))


def p6_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The planned table of results: key, parent key and inlined members."""
    _, rows = nested.crawl_tables(load_table(spark, sf_dir, "crawl_results"))
    return nested.flat_table(rows, "results", ["url", "status_code", "success", "metadata.title", "metadata.description"])


def p6_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The planned table of internal links, a child of the results: key, parent key and inlined members."""
    plan, rows = nested.crawl_tables(load_table(spark, sf_dir, "crawl_results"))
    return nested.flat_table(rows, plan.table(nested.LINKS), ["href", "text", "title"])


QUERIES = {"p3_found": p3_found, "p3_resolved": p3_resolved, "p6_found": p6_found, "p6_results": p6_results, "p6_links": p6_links}
