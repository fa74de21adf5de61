"""Best representative of each group of duplicate records, field by field.

Each attribute of a group is decided by one aggregation that takes the maximum of a composite struct: usable value,
confidence, source priority, observation time, length, value. ``survivors`` works on candidate arrays in long form; a
value that truly continues the best one (a cut text and its whole) replaces it.

Defined results: null, blank and stand-in values never survive; a group without a usable value gives no row; unknown
sources rank last, null times last; repeated rows change nothing; ties end with the smallest value by code point; null
keys form their own groups; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.text import WHITE_CLASS

#: Texts that stand for "no value", lower-cased; values without any letter or digit count as such too.
STAND_INS = (
    "unknown", "undefined", "null", "none", "nil", "nan", "n/a", "n.a.", "na", "tbd", "tba", "tbc", "todo", "not available", "not applicable",
    "not specified", "not provided", "unspecified", "unavailable", "untitled", "(untitled)", "[untitled]", "no title", "no value", "no author",
    "(none)", "(null)", "(unknown)", "[unknown]", "(empty)", "empty", "missing", "unbekannt", "ohne titel", "keine angabe", "inconnu", "sans titre",
    "non disponible", "desconocido", "sin título", "sin titulo", "no disponible",
)
#: Confidence from best to worst.
CONFIDENCE = ("high", "medium", "low")
ELLIPSIS = "(?:" + WHITE_CLASS + "*(?:\\x{2026}|\\.(?:" + WHITE_CLASS + "?\\.){2,}|[\\[(]" + WHITE_CLASS + "*(?:\\x{2026}|\\.{2,})" + WHITE_CLASS + "*[\\])]|\\x{22ef}))+" + WHITE_CLASS + "*$"


def clean_value(value: Column) -> Column:
    """Trimmed, each run of white space as one space; null when nothing usable is left."""
    spaced = F.btrim(F.regexp_replace(value, WHITE_CLASS + "+", " "))
    useless = ~spaced.rlike("[\\p{L}\\p{N}]") | F.lower(spaced).isin(*STAND_INS)
    return F.when(spaced.isNotNull() & ~useless, spaced)


def stem(value: Column) -> Column:
    """The value without closing ellipses and the blanks before them."""
    return F.regexp_replace(value, ELLIPSIS, "")


def smaller_first(value: Column) -> Column:
    """A text whose order is the reverse of the order of ``value`` by code point."""
    return F.concat(F.translate(F.hex(F.encode(value, "UTF-8")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))


def survivors(candidates: DataFrame, keys: list[str], priorities: DataFrame | None = None, priority_keys: list[str] | None = None) -> DataFrame:
    """One row per group with a usable value: keys and ``value``.

    ``candidates`` has the keys and value, source, confidence, observed_at in long form. ``priorities`` gives
    ``source_rank`` (0 = most trusted) per ``priority_keys``; it is a small catalogue and joined by hash on its keys.
    """
    rows = candidates.select(*keys, clean_value(F.col("value")).alias("value"), "source", F.lower(F.regexp_replace("confidence", f"^{WHITE_CLASS}+|{WHITE_CLASS}+$", "")).alias("_conf"), "observed_at")
    rows = rows.filter("value IS NOT NULL")
    if priorities is not None:
        on = priority_keys or ["source"]
        ranks = priorities.groupBy(*on).agg(F.min("source_rank").alias("_rank"))
        rows = rows.join(ranks, on, "left")
    else:
        rows = rows.withColumn("_rank", F.lit(None).cast("int"))
    conf = F.coalesce(*[F.when(F.col("_conf") == c, F.lit(len(CONFIDENCE) - k)) for k, c in enumerate(CONFIDENCE)], F.lit(0))
    quality = F.struct(
        conf.alias("confidence"),
        F.coalesce(-F.col("_rank"), F.lit(-(1 << 31))).alias("priority"),
        F.coalesce(F.unix_micros(F.col("observed_at").cast("timestamp")), F.lit(-(1 << 63))).alias("at"),
        F.length("value").alias("length"),
        smaller_first(F.col("value")).alias("order"),
        F.col("value").alias("value"),
    )
    # Distinct values first: copies of a hot group collapse before the shuffle on the group's key alone.
    distinct = rows.groupBy(*keys, "value").agg(F.max(quality).alias("_q"))
    best = distinct.groupBy(*keys).agg(F.max("_q").alias("_best"))
    best = best.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_best.value").alias("_best"), stem(F.col("_best.value")).alias("_stem"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    value, its = F.col("value"), stem(F.col("value"))
    longer = (F.length(its) > F.length("_stem")) & its.startswith(F.col("_stem")) & (F.length("_stem") > 0)
    only = lambda c: F.when(longer, c)
    whole = F.max(F.struct(longer.cast("int").alias("a"), only(F.length(its)).alias("b"), only(its == value).alias("c"), only(smaller_first(value)).alias("d"), F.when(longer, value).otherwise(F.col("_best")).alias("value")))
    met = best.join(distinct.select(*keys, "value"), same).groupBy(*[F.col(f"_k{i}") for i in range(len(keys))]).agg(whole.alias("_w"))
    return met.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], F.col("_w.value").alias("value"))


def resolve_metadata(conflicts: DataFrame, sources: DataFrame) -> DataFrame:
    """document_id, field_name, value: the surviving value of every document and field."""
    long = conflicts.select("document_id", "field_name", "observed_at", F.explode("candidates").alias("c")).select(
        "document_id", "field_name", "observed_at", F.col("c.value").alias("value"), F.col("c.source").alias("source"), F.col("c.confidence").alias("confidence")
    )
    return survivors(long, ["document_id", "field_name"], sources, ["field_name", "source"])
