"""Text columns: white space, words, token sets, time texts of the strict kind."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def fingerprint(text: Column) -> Column:
    return F.sha2(squeeze(text), 256)


def tokens(text: Column) -> Column:
    """Distinct lower-case runs of ASCII letters and digits, longer than one character."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda t: F.length(t) > 1))


def overlap(query: Column, text: Column) -> Column:
    """Share of the query's tokens that occur in the text; 0 without any."""
    q = tokens(query)
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, tokens(text))) / F.greatest(F.size(q), F.lit(1)))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, SPACE), lambda w: w != ""))


def cut_words(text: Column, n: Column) -> Column:
    """The first ``n`` words with the text between them."""
    return F.call_function("regexp_extract", text, F.concat(F.lit(r"^(\s*(?:\S+\s+){0,"), F.greatest(n - 1, F.lit(0)).cast("string"), F.lit(r"}\S+)")), F.lit(1))


def preclean(text: Column, source_type: Column) -> Column:
    """Web Markdown without lines that hold only an image and with single blank lines; all texts trimmed."""
    web = F.regexp_replace(F.regexp_replace(text, r"(?m)^\s*!\[[^\]]*\]\([^)]*\)\s*$", ""), "\n{3,}", "\n\n")
    return F.regexp_replace(F.when(source_type == "WEB_MARKDOWN", web).otherwise(text), r"^\s+|\s+$", "")


def strict_instant(value: Column) -> Column:
    """Date-only, ISO with an offset, or RFC 2822 text as a timestamp; anything without a zone is null."""
    v = F.trim(value)
    iso = F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}(:\d{2}([.,]\d{1,6})?)?(Z|z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(F.regexp_replace(F.regexp_replace(F.upper(v), r"([+-]\d{2})(\d{2})$", "$1:$2"), ",", ".")))
    day = F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(v))
    mail = F.regexp_replace(F.regexp_replace(v, r"^[A-Za-z]{3}, ", ""), r"(GMT|UTC|UT)$", "+0000")
    rfc = F.when(mail.rlike(r"^\d{1,2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4}$"), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z")))
    return F.when(F.length(value) <= 128, F.coalesce(day, iso, rfc))


def retry_after(value: Column, now: Column, most: int) -> Column:
    """Seconds to wait: a number, or an HTTP date against ``now``; at most ``most``."""
    v = F.trim(value)
    seconds = F.when(v.rlike(r"^\d{1,9}$"), v.cast("long"))
    at = strict_instant(v)
    until = F.when(at.isNotNull(), F.greatest(F.lit(0).cast("long"), F.unix_timestamp(at) - F.unix_timestamp(now)))
    delay = F.coalesce(seconds, until)
    return F.when(delay.isNotNull(), F.least(delay, F.lit(most).cast("long")))
