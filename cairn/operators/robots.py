"""robots.txt and sitemaps: parsing, rule matching as joins, entry order, frontier by levels."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import quote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.texts import strict_instant
from cairn.functions.url import dedup_key, host, part, remove_dot_segments
from cairn.session import checkpoint

RULES = "agent string, allow boolean, pattern string, specificity int, regex string, crawl_delay double"


def normal_octets(path: str) -> str:
    """Unreserved octets decoded, other escapes in upper case, non-ASCII characters encoded."""
    out = re.sub(r"%[0-9A-Fa-f]{2}", lambda m: c if re.fullmatch(r"[A-Za-z0-9._~-]", c := chr(int(m.group()[1:], 16))) else m.group().upper(), path)
    return "".join(c if ord(c) < 128 else quote(c) for c in out)


def rule_regex(pattern: str) -> str:
    """A robots pattern (``*`` anywhere, ``$`` at the end) as a Java regular expression for a prefix match."""
    anchored = pattern.endswith("$")
    body = normal_octets(pattern[:-1] if anchored else pattern)
    escaped = "".join(".*" if c == "*" else c if c.isalnum() or c in "/_%" else "\\" + c for c in body)
    return f"^{escaped}{'$' if anchored else ''}"


def parse_robots(body: str | None) -> list[tuple[str, bool | None, str | None, int | None, str | None, float | None]]:
    """Rules of all groups: agent, allow, pattern, specificity, regex, crawl delay (0 to 86400 s).

    A group without rules gives one row whose rule is null, as it still takes the place of ``*`` for its agents.
    """
    groups: list[tuple[list[str], list[tuple[bool, str]], list[float]]] = []
    fresh = False
    for raw in (body or "").splitlines():
        key, sep, value = raw.split("#", 1)[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if not sep:
            continue
        if key == "user-agent":
            if not fresh:
                groups.append(([], [], []))
            groups[-1][0].append(value.lower())
            fresh = True
            continue
        fresh = False
        if not groups:
            continue
        if key in ("allow", "disallow") and value:
            groups[-1][1].append((key == "allow", value))
        elif key == "crawl-delay":
            try:
                if 0 <= (delay := float(value)) <= 86_400:
                    groups[-1][2].append(delay)
            except ValueError:
                pass
    return [
        (agent, allow, pattern, *((None, None) if pattern is None else (len(normal_octets(pattern.rstrip("$").replace("*", ""))), rule_regex(pattern))), max(delays) if delays else None)
        for agents, rules, delays in groups
        for agent in agents
        for allow, pattern in rules or [(None, None)]
    ]


def robots_rules(files: DataFrame, origin_col: str, body_col: str) -> DataFrame:
    """One row per origin, agent and rule; one without a rule for a group that has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(o, *r) for o, b in zip(batch[origin_col], batch[body_col], strict=True) for r in parse_robots(b)]
            frame = pd.DataFrame(rows, columns=[origin_col, "agent", "allow", "pattern", "specificity", "regex", "crawl_delay"])
            yield frame.astype({"allow": "boolean", "specificity": "Int32", "crawl_delay": "float64"})

    return files.select(origin_col, body_col).mapInPandas(run, f"{origin_col} string, {RULES}")


def robots_sitemaps(files: DataFrame, origin_col: str, body_col: str) -> DataFrame:
    """origin, sitemap of every Sitemap line, whatever group it stands in."""
    lines = F.regexp_extract_all(F.regexp_replace(F.col(body_col), "#[^\n]*", ""), F.lit(r"(?im)^[ \t]*sitemap[ \t]*:[ \t]*(\S+)"), F.lit(1))
    return files.select(origin_col, F.explode(F.array_distinct(lines)).alias("sitemap"))


def available_decisions(decisions: DataFrame, urls: DataFrame, id_col: str, url_col: str, states: DataFrame, origin_col: str) -> DataFrame:
    """Decisions with the state of each origin's file: ``unreachable`` denies all, ``missing`` allows all, an unknown origin is unreachable.

    ``states`` has the origin and ``state``, one row per origin.
    """
    known = states.groupBy(F.col(origin_col).alias("_o")).agg(F.max("state").alias("_s"))
    rows = urls.select(id_col, host(url_col).alias("_o")).join(known, "_o", "left").join(decisions, id_col, "left")
    allowed = F.when(F.coalesce("_s", F.lit("unreachable")) == "unreachable", False).when(F.col("_s") == "missing", True).otherwise(F.coalesce("allowed", F.lit(True)))
    return rows.select(id_col, allowed.alias("allowed"))


def robots_decisions(urls: DataFrame, id_col: str, url_col: str, rules: DataFrame, origin_col: str, agent: str) -> DataFrame:
    """id and ``allowed``: the longest matching rule wins, allow wins ties, no match allows.

    Rules of the agent, or of ``*`` where an origin names no such group. One aggregation per URL, no window.
    """
    own = rules.filter(F.col("agent") == agent.lower())
    rest = rules.filter("agent = '*'").join(own.select(origin_col).distinct(), origin_col, "left_anti")
    used = own.unionByName(rest).select(F.col(origin_col).alias("_o"), "allow", "specificity", "regex")
    target = F.concat(F.when(part(url_col, 3) == "", "/").otherwise(part(url_col, 3)), F.when(part(url_col, 4) == "", "").otherwise(F.concat(F.lit("?"), part(url_col, 4))))
    met = urls.select(id_col, host(url_col).alias("_o"), target.alias("_t")).join(used, "_o", "left")
    hit = F.expr("_t rlike regex")
    best = met.groupBy(id_col).agg(F.max(F.when(hit, F.struct("specificity", "allow"))).alias("b"))
    return best.select(id_col, F.coalesce("b.allow", F.lit(True)).alias("allowed"))


def sitemap_order(entries: DataFrame, group_col: str, modified_col: str, priority_col: str, order_col: str, keep: int) -> DataFrame:
    """The first ``keep`` entries of each sitemap: dated first, newest first, then by priority, then in document order."""
    priority = F.when(F.col(priority_col).between(0, 1) & ~F.isnan(priority_col), F.col(priority_col))
    w = Window.partitionBy(group_col).orderBy(F.desc_nulls_last("_at"), F.desc_nulls_last("_priority"), order_col)
    ranked = entries.withColumn("_at", strict_instant(F.col(modified_col))).withColumn("_priority", priority).withColumn("rank", F.row_number().over(w))
    return ranked.filter(F.col("rank") <= keep).drop("_at", "_priority")


def parse_sitemap(content: str | None, max_bytes: int | None = None) -> tuple[str | None, list[tuple[str, str | None, str | None, int]], str | None]:
    """(kind, entries (loc, lastmod, priority, order), reason of failure). Finds the document inside viewer markup."""
    if content is None:
        return None, [], "empty"
    if max_bytes is not None and len(content.encode("utf-8", "surrogatepass")) > max_bytes:
        return None, [], "body_too_large"
    if re.search(r"<!(?:DOCTYPE|ENTITY)", content, re.I):
        return None, [], "unsafe_xml"
    local = lambda tag: str(tag).rpartition("}")[2].lower()
    tree = None
    for text in (content, *(m.group() for m in re.finditer(r"(?is)<(urlset|sitemapindex)[\s>].*?</\1>", content))):
        try:
            tree = ElementTree.fromstring(text)
            break
        except ElementTree.ParseError:
            continue
    if tree is None:
        return None, [], "malformed_xml"
    top = next((e for e in tree.iter() if local(e.tag) in ("urlset", "sitemapindex")), None)
    if top is None:
        return None, [], "unsupported_root"
    kind = local(top.tag)
    entries = []
    for child in top:
        if local(child.tag) == ("url" if kind == "urlset" else "sitemap"):
            fields = {local(e.tag): (e.text or "").strip() or None for e in child}
            if fields.get("loc"):
                entries.append((fields["loc"], fields.get("lastmod"), fields.get("priority"), len(entries)))
    return ("urlset" if kind == "urlset" else "index"), entries, None


def sitemap_entries(files: DataFrame, key_col: str, body_col: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, body in zip(batch[key_col], batch[body_col], strict=True):
                kind, entries, reason = parse_sitemap(body)
                rows.extend((key, kind, *e, None) for e in entries)
                if reason:
                    rows.append((key, None, None, None, None, None, reason))
            yield pd.DataFrame(rows, columns=[key_col, "kind", "url", "modified_at", "priority", "entry_order", "reason"])

    return files.select(key_col, body_col).mapInPandas(run, f"{key_col} string, kind string, url string, modified_at string, priority string, entry_order int, reason string")


def resolve(base: Column, href: Column) -> Column:
    """Absolute form of a link: absolute, scheme-relative, rooted, query-only and relative references; no fragment."""
    h = F.regexp_replace(F.trim(href), "#.*$", "")
    root = F.concat(part(base, 1), F.lit("://"), part(base, 2))
    folder = F.regexp_extract(F.when(part(base, 3) == "", "/").otherwise(part(base, 3)), "^(.*/)", 1)
    path = lambda p: remove_dot_segments(F.regexp_replace(p, r"\?.*$", ""))
    tail = F.regexp_extract(h, r"(\?.*)$", 1)
    return (
        F.when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), h)
        .when(h.startswith("//"), F.concat(part(base, 1), F.lit(":"), h))
        .when(h == "", F.substring_index(base, "#", 1))
        .when(h.startswith("?"), F.concat(root, part(base, 3), h))
        .when(h.startswith("/"), F.concat(root, path(h), tail))
        .otherwise(F.concat(root, path(F.concat(folder, h)), tail))
    )


def frontier(seeds: DataFrame, links: DataFrame, max_depth: int, max_urls: int | None = None) -> DataFrame:
    """Breadth-first discovery: key, depth and the smallest parent key of every URL within ``max_depth`` links of a seed.

    ``seeds`` has ``url``; ``links`` has ``source`` and ``target``. One join per level against what is known; each level
    is written to the shared checkpoint folder.
    """
    edges = checkpoint(links.select(dedup_key("source").alias("s"), dedup_key("target").alias("key")).filter("s <> key").distinct())  # read once per level
    level = seeds.select(dedup_key("url").alias("key"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent")).dropDuplicates(["key"])
    known = level = checkpoint(level)
    for depth in range(1, max_depth + 1):
        found = edges.join(level.select(F.col("key").alias("s")), "s").groupBy("key").agg(F.min("s").alias("parent"))
        level = checkpoint(found.join(known.select("key"), "key", "left_anti").select("key", F.lit(depth).alias("depth"), "parent"))
        if level.isEmpty():
            break
        known = known.unionByName(level)
    return known if max_urls is None else known.orderBy("depth", "key").limit(max_urls)


def redirect_merge(records: DataFrame, key_col: str, final_col: str) -> DataFrame:
    """Records whose final URLs have one key, merged: the key, the smallest requested key and their number."""
    return records.groupBy(dedup_key(final_col).alias("final_key")).agg(F.min(dedup_key(key_col)).alias("first_key"), F.count("*").alias("n"))


