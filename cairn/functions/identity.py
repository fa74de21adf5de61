"""Content-addressed ids: documents, evidence spans, cache keys, scopes, jitter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions.url import cache_identity, without_fragment


def _bytes(text: Column) -> Column:
    return F.encode(text, "UTF-8")



def source_hash(markdown: Column) -> Column:
    return F.sha2(markdown, 256)


def document_id(final_url: Column, markdown: Column) -> Column:
    """sha256 of the URL without fragment, a zero byte and the digest of the Markdown."""
    return F.sha2(F.concat(_bytes(without_fragment(final_url)), F.unhex(F.lit("00")), F.unhex(F.sha2(markdown, 256))), 256)


def evidence_id(final_url: Column, markdown_sha: Column, start: Column, end: Column) -> Column:
    """sha256 over URL, Markdown digest and ``start:end``; null for empty or negative spans."""
    span = F.concat(start.cast("string"), F.lit(":"), end.cast("string"))
    zero = F.unhex(F.lit("00"))
    digest = F.sha2(F.concat(_bytes(without_fragment(final_url)), zero, F.unhex(markdown_sha), zero, _bytes(span)), 256)
    return F.when((start >= 0) & (end > start), digest)


def cache_key(url: Column, capabilities: Column, variant: str, cleaner: Column, version: str = "cache-identity@1") -> Column:
    """sha256 of the sorted JSON of everything that decides what a cached page holds."""
    payload = F.to_json(F.struct(F.array_sort(capabilities).alias("capabilities"), cleaner.alias("cleaner_version"), F.lit(variant).alias("retrieval_variant"), cache_identity(url).alias("url"), F.lit(version).alias("version")))
    return F.sha2(payload, 256)


def short_hash(text: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def jitter(host: Column, most: float) -> Column:
    """Deterministic share of ``most`` from the first two digest bytes."""
    return F.conv(F.substring(F.sha2(host, 256), 1, 4), 16, 10).cast("double") / F.lit(65535.0) * F.lit(most)


def cursor(job: Column, after: Column) -> Column:
    """URL-safe base64 of a JSON cursor."""
    raw = F.to_json(F.struct(F.lit(1).alias("v"), job.alias("job"), after.alias("after")))
    return F.rtrim(F.translate(F.base64(F.encode(raw, "UTF-8")), "+/\r\n", "-_"), F.lit("="))


def read_cursor(text: Column) -> Column:
    """The cursor's fields, null if it is not one."""
    padded = F.rpad(F.translate(text, "-_", "+/"), F.ceil(F.length(text) / 4).cast("int") * 4, F.lit("="))
    return F.from_json(F.decode(F.try_to_binary(padded, F.lit("base64")), "UTF-8"), "v int, job string, after long")
