"""cairn: a Spark-native engine for crawled evidence (pages, passages, hits, documents)."""

from cairn.session import checkpoint, get_spark, load_table

__all__ = ["checkpoint", "get_spark", "load_table"]
