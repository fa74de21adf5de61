"""Queries over HTML bodies and URL safety."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import safety
from cairn.operators import html
from cairn.plans.registry import query


def _extracted(t):
    p = t.page_cache.filter("raw_html IS NOT NULL").withColumn("base", F.coalesce("final_url", "requested_url"))
    return html.extract(p, "record_id", "raw_html", "base")


@query(r"""WITH a AS (SELECT record_id, unnest(regexp_extract_all(raw_html, '<a href="[^"]*"[^>]*>')) AS m FROM page_cache WHERE raw_html IS NOT NULL)
  SELECT record_id, count(*) AS n_links, count_if(regexp_matches(m, '"https?://')) AS n_external FROM a GROUP BY record_id""")
def page_links(t):
    links = _extracted(t).select("record_id", F.explode("links").alias("l"))
    return links.groupBy("record_id").agg(F.count("*").alias("n_links"), F.count_if("l.external").alias("n_external"))


@query(r"""SELECT record_id, len(regexp_extract_all(raw_html, '<title>')) AS n_titles, trim(regexp_extract(raw_html, '<title>([^<]*)</title>', 1)) AS title, lower(regexp_extract(raw_html, '<html lang="([^"]*)"', 1)) AS language FROM page_cache WHERE raw_html IS NOT NULL""")
def page_metadata(t):
    c = _extracted(t).select("record_id", F.filter("candidates", lambda x: x["source"] == "html_title").alias("titles"), F.filter("candidates", lambda x: x["source"] == "html_lang").alias("langs"))
    return c.select("record_id", F.size("titles").cast("long").alias("n_titles"), F.col("titles")[0]["value"].alias("title"), F.col("langs")[0]["value"].alias("language"))


@query()
def page_tables(t):
    p = t.page_cache.filter("raw_html IS NOT NULL").withColumn("body", F.regexp_replace("raw_html", r"(?s)((?:<tr>.*?</tr>\s*)+)", "<table>$1</table>"))
    return html.extract(p.withColumn("base", F.lit("")), "record_id", "body", "base").select("record_id", F.explode("cells").alias("c")).select("record_id", "c.*")


@query(r"""SELECT record_id, CASE WHEN regexp_matches(raw_html, '<h1[ >]') THEN 'found' ELSE 'missing' END AS state, trim(regexp_extract(raw_html, '<h1[^>]*>([^<]*)</h1>', 1)) AS text FROM page_cache WHERE raw_html IS NOT NULL""")
def target_watch(t):
    return html.watch(t.page_cache.filter("raw_html IS NOT NULL"), "record_id", "raw_html", css="h1")


@query("""WITH c AS (SELECT document_id, field_name, unnest(candidates) AS c FROM metadata_conflicts), k AS (SELECT c.document_id, c.field_name, c.c.value AS value, coalesce(c.c.source, '~') AS source, coalesce(s.source_rank, 1073741824) AS r FROM c LEFT JOIN metadata_sources s ON s.field_name = c.field_name AND s.source = c.c.source WHERE c.c.value IS NOT NULL),
  n AS (SELECT *, row_number() OVER (PARTITION BY document_id, field_name ORDER BY r, source, value) AS k FROM k)
  SELECT n.document_id, n.field_name, n.value, n.source, d.d > 1 AS conflict FROM n JOIN (SELECT document_id, field_name, count(DISTINCT value) AS d FROM k GROUP BY 1, 2) d ON d.document_id IS NOT DISTINCT FROM n.document_id AND d.field_name = n.field_name WHERE n.k = 1""")
def metadata_select(t):
    long = t.metadata_conflicts.select("document_id", "field_name", F.explode("candidates").alias("c")).select("document_id", "field_name", "c.value", "c.source")
    return html.metadata_choice(long, ["document_id", "field_name"], t.metadata_sources, ["field_name", "source"])


@query("""WITH a AS (SELECT host, ('0x' || md5(host)[1:2])::INT AS b FROM hosts)
  SELECT result_id FROM discovery_results r JOIN a ON a.host = lower(regexp_extract(r.url, '(?i)^https?://([^/:?#]*)', 1)) WHERE b NOT IN (0, 10, 127) AND b < 224""")
def url_safety(t):
    first = F.conv(F.substring(F.md5("host"), 1, 2), 16, 10)
    addresses = t.hosts.select("host", F.concat(first, F.lit(".20.30.40")).alias("ip"))
    return safety.safe_urls(t.discovery_results, "url", addresses).select("result_id")
