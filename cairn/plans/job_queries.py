"""Queries over jobs, robots, sitemaps, vectors, chunks and event time."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import texts
from cairn.operators import chunking, jobs, robots
from cairn.plans.evidence_queries import _sql_host, _sql_part
from cairn.plans.registry import query
from cairn.streaming import windows


@query("""SELECT crawl_id, CASE WHEN n = 1 THEN 'created' WHEN md5(requested_url) IS NOT DISTINCT FROM first_value(md5(requested_url)) OVER w THEN 'replayed' ELSE 'conflict' END AS claim
  FROM (SELECT *, row_number() OVER (PARTITION BY host, crawl_id % 50 ORDER BY received_at, crawl_id) AS n FROM crawl_results)
  WINDOW w AS (PARTITION BY host, crawl_id % 50 ORDER BY received_at, crawl_id)""")
def job_claim(t):
    r = t.crawl_results.withColumn("key", F.col("crawl_id") % 50).withColumn("fp", F.md5("requested_url"))
    return jobs.claims(r, "host", "key", "fp", ["received_at", "crawl_id"]).select("crawl_id", "claim")


@query("""SELECT job_id, requested_url, crawl_id, row_number() OVER (PARTITION BY job_id ORDER BY received_at, crawl_id) AS ordinal FROM
  (SELECT *, row_number() OVER (PARTITION BY job_id, requested_url ORDER BY received_at, crawl_id) AS n FROM crawl_results) WHERE n = 1""")
def job_append(t):
    return jobs.append_results(t.crawl_results.select("job_id", "requested_url", "crawl_id", "received_at"), "job_id", "requested_url", ["received_at", "crawl_id"]).select("job_id", "requested_url", "crawl_id", "ordinal")


@query("""WITH k AS (SELECT host, requested_url, max(CASE WHEN outcome = 'content' THEN 1 ELSE 0 END) AS ok FROM page_cache GROUP BY 1, 2)
  SELECT host, count(*) AS processed, sum(ok)::BIGINT AS succeeded, sum(1 - ok)::BIGINT AS failed, CASE WHEN sum(1 - ok) = 0 THEN 'completed' WHEN sum(ok) > 0 THEN 'partial' ELSE 'failed' END AS state FROM k GROUP BY host""")
def job_counters(t):
    return jobs.counters(t.page_cache, "host", "requested_url", F.col("outcome") == "content")


@query("""WITH r AS (SELECT DISTINCT host, requested_url FROM page_cache WHERE outcome = 'content'),
  f AS (SELECT p.* FROM page_cache p WHERE outcome <> 'content' AND NOT EXISTS (SELECT 1 FROM r WHERE r.host = p.host AND r.requested_url = p.requested_url))
  SELECT host, count(DISTINCT requested_url) AS n_failed, array_to_string(list_sort(list(DISTINCT outcome))[1:16], ',') AS reasons FROM f GROUP BY host""")
def job_failures(t):
    p = t.page_cache
    out = jobs.open_failures(p.filter("outcome <> 'content'"), p.filter("outcome = 'content'"), "host", "requested_url", "outcome")
    return out.withColumn("reasons", F.array_join("reasons", ","))


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY received_at, crawl_id) AS ordinal FROM crawl_results),
  p AS (SELECT *, sum(coalesce(strlen(payload), 0)) OVER (PARTITION BY host ORDER BY ordinal ROWS UNBOUNDED PRECEDING)::BIGINT AS running_bytes FROM o WHERE ordinal > 3 AND ordinal <= 13)
  SELECT crawl_id, ordinal, running_bytes FROM p WHERE running_bytes <= 65536""")
def job_page(t):
    r = t.crawl_results.withColumn("n_bytes", F.coalesce(F.octet_length("payload"), F.lit(0)))
    return jobs.result_page(_numbered(r), "host", 3, 10, 65_536, "n_bytes").select("crawl_id", "ordinal", "running_bytes")


def _numbered(r):
    from pyspark.sql import Window

    return r.withColumn("ordinal", F.row_number().over(Window.partitionBy("host").orderBy("received_at", "crawl_id")))


@query("""SELECT record_id, CASE WHEN outcome = 'content' THEN 'completed' ELSE 'failed' END AS before,
  CASE WHEN expires_at <= 1750000000 THEN 'expired' WHEN outcome = 'content' THEN 'completed' ELSE 'failed' END AS state FROM page_cache WHERE expires_at IS NULL OR expires_at > 1750000000 OR expires_at + 31536000 > 1750000000""")
def job_expire(t):
    p = t.page_cache.withColumn("before", F.when(F.col("outcome") == "content", "completed").otherwise("failed")).withColumn("state", F.col("before"))
    return jobs.expire(p, F.lit(1_750_000_000.0), "expires_at", "state", 31_536_000.0).select("record_id", "before", "state")


@query("""WITH s AS (SELECT unnest(list_filter(['discovered', CASE WHEN outcome <> 'policy_denied' THEN 'queued' END, CASE WHEN outcome = 'content' THEN 'fetched' ELSE 'failed' END], lambda x: x IS NOT NULL)) AS state FROM page_cache) SELECT state, count(*) AS n FROM s GROUP BY state""")
def site_state_counts(t):
    states = F.array_compact(F.array(F.lit("discovered"), F.when(F.col("outcome") != "policy_denied", "queued"), F.when(F.col("outcome") == "content", "fetched").otherwise("failed")))
    return jobs.state_counts(t.page_cache.withColumn("states", states), "states")


ROBOTS = "User-agent: *\nDisallow: /passage/\nDisallow: /*/archive$\nAllow: /passage/a\nDisallow: /*?q=\nCrawl-delay: 2\n\nUser-agent: other\nDisallow: /\n"
_T = f"CASE WHEN {_sql_part('url', 3)} = '' THEN '/' ELSE {_sql_part('url', 3)} END || CASE WHEN {_sql_part('url', 4)} = '' THEN '' ELSE '?' || {_sql_part('url', 4)} END"


@query(rf"""WITH u AS (SELECT entry_id, {_T} AS t, {_sql_host('url')} AS h FROM sitemap_entries),
  m AS (SELECT entry_id, max({{'specificity': r.n, 'allow': r.allow}}) AS b FROM u JOIN (VALUES (9, false, '^/passage/'), (9, false, '^/.*/archive$'), (10, true, '^/passage/a'), (4, false, '^/.*\?q\=')) r(n, allow, re) ON regexp_matches(t, re) AND h IN (SELECT host FROM hosts) GROUP BY entry_id)
  SELECT u.entry_id, coalesce(m.b.allow, true) AS allowed FROM u LEFT JOIN m USING (entry_id)""")
def robots_decision(t):
    files = t.hosts.select(F.col("host").alias("origin"), F.lit(ROBOTS).alias("body"))
    return robots.robots_decisions(t.sitemap_entries, "entry_id", "url", robots.robots_rules(files, "origin", "body"), "origin", "cairn")


@query(rf"""WITH u AS (SELECT entry_id, {_T} AS t, {_sql_host('url')} AS h FROM sitemap_entries)
  SELECT entry_id, CASE WHEN s.state IS NULL OR s.state = 'unreachable' THEN false WHEN s.state = 'missing' THEN true ELSE NOT regexp_matches(t, '^/dienst/') END AS allowed
  FROM u LEFT JOIN (SELECT host, CASE lang WHEN 'de' THEN 'unreachable' WHEN 'fr' THEN 'missing' ELSE 'available' END AS state FROM hosts WHERE lang <> 'es') s ON s.host = u.h""")
def robots_availability(t):
    state = F.when(F.col("lang") == "de", "unreachable").when(F.col("lang") == "fr", "missing").otherwise("available")
    files = t.hosts.filter("lang <> 'es'").select(F.col("host").alias("origin"), F.lit("User-agent: *\nDisallow: /dienst/").alias("body"), state.alias("state"))
    decided = robots.robots_decisions(t.sitemap_entries, "entry_id", "url", robots.robots_rules(files, "origin", "body"), "origin", "cairn")
    return robots.available_decisions(decided, t.sitemap_entries, "entry_id", "url", files, "origin")


@query("SELECT host, 'https://' || host || '/map.xml' AS sitemap FROM hosts")
def robots_sitemaps(t):
    body = F.concat(F.lit("User-agent: *\nDisallow:\n# Sitemap: no\nSITEMAP : https://"), F.col("host"), F.lit("/map.xml # main"))
    return robots.robots_sitemaps(t.hosts.select("host", body.alias("body")), "host", "body")


_AT = r"""CASE WHEN regexp_full_match(trim(modified_at), '\d{4}-\d{2}-\d{2}') THEN try_cast(trim(modified_at) AS TIMESTAMPTZ)
  WHEN regexp_full_match(trim(modified_at), '\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}(:\d{2}([.,]\d{1,6})?)?(Z|z|[+-]\d{2}:?\d{2})') THEN try_cast(replace(regexp_replace(upper(trim(modified_at)), '([+-]\d{2})(\d{2})$', '\1:\2'), ',', '.') AS TIMESTAMPTZ)
  WHEN regexp_matches(regexp_replace(regexp_replace(trim(modified_at), '^[A-Za-z]{3}, ', ''), '(GMT|UTC|UT)$', '+0000'), '^\d{1,2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4}$') THEN try_strptime(regexp_replace(regexp_replace(trim(modified_at), '^[A-Za-z]{3}, ', ''), '(GMT|UTC|UT)$', '+0000'), '%d %b %Y %H:%M:%S %z') END"""


@query(f"""SELECT entry_id, rank FROM (SELECT entry_id, row_number() OVER (PARTITION BY sitemap_url ORDER BY {_AT} DESC NULLS LAST, CASE WHEN priority BETWEEN 0 AND 1 THEN priority END DESC NULLS LAST, entry_order, entry_id) AS rank FROM sitemap_entries) WHERE rank <= 20""")
def sitemap_order(t):
    e = t.sitemap_entries.withColumn("place", F.struct("entry_order", "entry_id"))
    return robots.sitemap_order(e, "sitemap_url", "modified_at", "priority", "place", 20).select("entry_id", "rank")


@query(f"""SELECT entry_id, strftime(timezone('UTC', {_AT}), '%Y-%m-%dT%H:%M:%S') AS at FROM sitemap_entries WHERE ({_AT}) IS NOT NULL""")
def strict_times(t):
    at = texts.strict_instant(F.col("modified_at"))
    return t.sitemap_entries.select("entry_id", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("at")).filter("at IS NOT NULL")


@query()
def crawl_frontier(t):
    """Breadth-first discovery over the links of crawl payloads, from the first page of every host."""
    from cairn.operators.nested import crawl_fields

    r = t.crawl_results
    links = crawl_fields(r).filter("path = 'links.internal.href'").join(r.select("crawl_id", "requested_url"), "crawl_id")
    edges = links.select(F.col("requested_url").alias("source"), robots.resolve(F.col("requested_url"), F.col("val")).alias("target"))
    seeds = r.groupBy("host").agg(F.min("requested_url").alias("url")).select("url")
    return robots.frontier(seeds, edges, 3)


@query("""SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def adjacent_similarity(t):
    return chunking.adjacent_similarity(t.embeddings, "vec_id", "embedding").withColumn("similarity", F.round("similarity", 5))


@query("""SELECT a.label, round(quantile_cont(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 0.25), 5) AS border FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 GROUP BY a.label""")
def similarity_threshold(t):
    v = t.embeddings
    s = chunking.adjacent_similarity(v, "vec_id", "embedding").join(v.select("vec_id", "label"), "vec_id")
    return s.groupBy("label").agg(F.round(F.percentile("similarity", 0.25), 5).alias("border"))


@query("""SELECT a.vec_id // 16 AS block, a.vec_id AS a_id, b.vec_id AS b_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id // 16 = b.vec_id // 16 AND a.vec_id < b.vec_id""")
def block_cosine(t):
    return chunking.block_similarities(t.embeddings, "vec_id", "embedding").withColumn("similarity", F.round("similarity", 5))


def _chunks(t, embed):
    c = F.col
    return chunking.chunk_texts(t.chunk_requests, "request_id", "text", c("strategy_version"), c("params.max_chunk_tokens"), c("params.min_chunk_tokens"), c("params.initial_segment_tokens"), embed)


@query()
def semantic_chunks(t):
    return _chunks(t, chunking.hashed_vectors)


@query()
def greedy_chunks(t):
    return _chunks(t, None)


@query()
def overlap_chunks(t):
    return chunking.overlap_chunks(t.chunk_requests, "request_id", "text", 20, 80, 20)


@query()
def section_asof(t):
    """Nearest heading at or above each passage, in the first page of its document."""
    first = t.page_cache.filter("document_id IS NOT NULL").groupBy("document_id").agg(F.min("record_id").alias("record_id"))
    h = chunking.section_headings(t.page_cache.join(first.select("record_id"), "record_id", "left_semi"), "document_id", "markdown")
    return chunking.nearest_heading(t.passages.select("passage_id", "document_id", "start_index"), h, "document_id", "start_index").select("passage_id", "nearest_heading")


# -- event time --------------------------------------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling(t):
    return windows.tumbling(t.events, "ts", "1 hour", "event_type", "value")


@query("""SELECT time_bucket(INTERVAL 30 minute, ts) - INTERVAL 30 minute * k AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY 1, 2""")
def sliding(t):
    return windows.sliding(t.events, "ts", "1 hour", "30 minutes", "event_type", "value")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 hour THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
  SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k""")
def sessions(t):
    return windows.sessions(t.events, "ts", "2 hours", "user_id")
