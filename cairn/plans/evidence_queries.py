"""Queries over hits, pages and passages, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import identity, texts, url
from cairn.operators import discovery, pages, ranking
from cairn.plans.registry import query

QUERY_TEXT = "weekly harbour report near the library"
MAX_BYTES = 1_000_000

# Pieces of SQL shared below.
U = r"'^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$'"


def _sql_part(col: str, k: int) -> str:
    return f"regexp_extract({col}, {U}, {k})"


def _sql_host(col: str) -> str:
    return f"regexp_replace(lower(regexp_extract({_sql_part(col, 2)}, '^(?:.*@)?([^@:]+)(?::(\\d*))?$', 1)), '\\.+$', '')"


def _sql_netloc(col: str) -> str:
    port = f"regexp_extract({_sql_part(col, 2)}, '^(?:.*@)?([^@:]+)(?::(\\d*))?$', 2)"
    return f"{_sql_host(col)} || CASE WHEN {port} = '' OR {port} = CASE lower({_sql_part(col, 1)}) WHEN 'http' THEN '80' WHEN 'https' THEN '443' ELSE '' END THEN '' ELSE ':' || {port} END"


def _sql_query(col: str) -> str:
    return f"array_to_string(list_filter(string_split({_sql_part(col, 4)}, '&'), lambda c: c <> '' AND NOT starts_with(lower(c), 'utm_')), '&')"


def _sql_normalize(col: str) -> str:
    q = _sql_query(col)
    return f"lower({_sql_part(col, 1)}) || '://' || {_sql_netloc(col)} || regexp_replace({_sql_part(col, 3)}, '/+$', '') || CASE WHEN {q} = '' THEN '' ELSE '?' || {q} END"


def _sql_tokens(text: str) -> str:
    return f"list_distinct(list_filter(string_split(regexp_replace(lower({text}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: length(t) > 1))"


def _sql_overlap(text: str) -> str:
    return f"len(list_intersect({_sql_tokens(chr(39) + QUERY_TEXT + chr(39))}, {_sql_tokens(text)})) / len({_sql_tokens(chr(39) + QUERY_TEXT + chr(39))})"


@query(f"SELECT result_id, {_sql_normalize('url')} AS url_key FROM discovery_results")
def url_normalize(t):
    return t.discovery_results.select("result_id", url.normalize_url("url").alias("url_key"))


@query(f"""SELECT result_id, lower({_sql_part('url', 1)}) || '://' || {_sql_netloc('url')} || {_sql_part('url', 3)}
  || CASE WHEN {_sql_query('url')} = '' THEN '' ELSE '?' || {_sql_query('url')} END AS url_key FROM discovery_results""")
def url_dedup_key(t):
    return t.discovery_results.select("result_id", url.dedup_key("url").alias("url_key"))


@query(f"""SELECT record_id, lower({_sql_part('requested_url', 1)}) || '://' || {_sql_netloc('requested_url')}
  || CASE WHEN {_sql_part('requested_url', 3)} = '' THEN '/' ELSE {_sql_part('requested_url', 3)} END
  || CASE WHEN {_sql_part('requested_url', 4)} = '' THEN '' ELSE '?' || {_sql_part('requested_url', 4)} END AS url_key FROM page_cache""")
def url_cache_identity(t):
    return t.page_cache.select("record_id", url.cache_identity("requested_url").alias("url_key"))


@query(f"SELECT {_sql_host('url')} AS host, count(*) AS n, count(DISTINCT url) AS n_urls FROM discovery_results GROUP BY 1")
def url_host_counts(t):
    return t.discovery_results.groupBy(url.host("url").alias("host")).agg(F.count("*").alias("n"), F.count_distinct("url").alias("n_urls"))


@query("""SELECT record_id, sha256(encode(string_split(coalesce(final_url, requested_url), '#')[1]) || '\\x00'::BLOB || unhex(sha256(markdown))) AS doc_key,
  sha256(markdown) = source_hash AS hash_matches FROM page_cache WHERE markdown IS NOT NULL""")
def document_identity(t):
    p = t.page_cache.filter("markdown IS NOT NULL")
    return p.select("record_id", identity.document_id(F.coalesce("final_url", "requested_url"), F.col("markdown")).alias("doc_key"), (identity.source_hash(F.col("markdown")) == F.col("source_hash")).alias("hash_matches"))


@query("""SELECT passage_id, CASE WHEN start_index >= 0 AND end_index > start_index THEN
  sha256(encode(string_split(source_url, '#')[1]) || '\\x00'::BLOB || unhex(sha256(text)) || '\\x00'::BLOB || encode(start_index::VARCHAR || ':' || end_index::VARCHAR)) END AS span_key
  FROM passages WHERE text IS NOT NULL""")
def evidence_identity(t):
    p = t.passages.filter("text IS NOT NULL")
    return p.select("passage_id", identity.evidence_id(F.col("source_url"), F.sha2("text", 256), F.col("start_index"), F.col("end_index")).alias("span_key"))


@query("SELECT host, (('0x' || sha256(host)[1:4])::BIGINT) / 65535.0 * 2.5 AS jitter, sha256(host)[1:16] AS short_hash FROM hosts")
def host_jitter(t):
    return t.hosts.select("host", identity.jitter(F.col("host"), 2.5).alias("jitter"), identity.short_hash(F.col("host")).alias("short_hash"))


@query("SELECT crawl_id, job_id AS job, crawl_id AS after, 1 AS v FROM crawl_results WHERE job_id IS NOT NULL")
def cursor_round_trip(t):
    c = identity.read_cursor(identity.cursor(F.col("job_id"), F.col("crawl_id")))
    return t.crawl_results.filter("job_id IS NOT NULL").select("crawl_id", c.alias("c")).select("crawl_id", "c.job", "c.after", "c.v")


SEED = "https://dreibror-post.example/"


@query(f"""WITH c AS (SELECT entry_id, url, entry_order % 6 AS depth, {_sql_host('url')} AS h, lower({_sql_part('url', 1)}) AS s, {_sql_part('url', 3)} AS p FROM sitemap_entries)
  SELECT entry_id, CASE WHEN depth > 4 THEN 'depth_exceeded' WHEN h = '' THEN 'invalid_url' WHEN s <> 'https' OR NOT (h = 'dreibror-post.example') THEN 'outside_origin'
  WHEN regexp_matches(p, '^/passage/.*$') THEN 'excluded_path' WHEN lower(regexp_extract(p, '[^/.][^/]*?(\\.[^./]+)$', 1)) NOT IN ('', '.htm', '.html', '.pdf') THEN 'unsupported_file_type' END AS reason FROM c""")
def scope_filter(t):
    return t.sitemap_entries.select("entry_id", url.scope_rejection("url", F.col("entry_order") % 6, SEED, 4, exclude=("/passage/*",)).alias("reason"))


# -- hits --------------------------------------------------------------------------------------------------------------

_ENGINES = "list_filter(list_transform(coalesce(engines, []), lambda e: trim(e)), lambda e: e <> '')[1:16]"
_HITS = f"""hits AS (
  SELECT result_id, query_id, url, host, content, coalesce(CASE WHEN trim(title) <> '' THEN title END, url) AS title,
    coalesce(CASE WHEN trim(engine) <> '' THEN trim(engine) END, ({_ENGINES})[1]) AS engine,
    CASE WHEN score > 0 THEN score ELSE 1.0 / (coalesce(positions[1], 1) + 1) END AS score, positions,
    CASE WHEN len({_ENGINES}) > 0 THEN {_ENGINES} WHEN coalesce(trim(engine), '') <> '' THEN [trim(engine)] ELSE [] END AS all_engines
  FROM discovery_results WHERE trim(coalesce(url, '')) <> ''),
  votes AS (SELECT result_id, query_id, url, score, e AS engine, CASE WHEN positions[list_position(all_engines, e)] > 0 THEN positions[list_position(all_engines, e)] END AS position
    FROM (SELECT *, unnest(list_distinct(all_engines)) AS e FROM hits))"""


def _hits(t):
    return discovery.normal_hits(t.discovery_results, F.coalesce(F.try_element_at("positions", F.lit(1)), F.lit(1)))


@query(f"WITH {_HITS} SELECT h.result_id, h.title, h.engine, round(h.score, 6) AS score, (SELECT count(*) FROM votes v WHERE v.result_id = h.result_id) AS n_contributions FROM hits h")
def hit_defaults(t):
    return _hits(t).select("result_id", "title", "engine", F.round("score", 6).alias("score"), F.size("contributions").cast("long").alias("n_contributions"))


@query(f"""WITH {_HITS}, keyed AS (SELECT *, {_sql_normalize('url')} AS key FROM hits),
  best AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, result_id) AS n, count(*) OVER (PARTITION BY key) AS n_hits FROM keyed),
  v AS (SELECT DISTINCT {_sql_normalize('url')} AS key, query_id, engine, position FROM votes),
  counted AS (SELECT key, count(*) AS n_contributions, count(DISTINCT engine) AS n_engines FROM v GROUP BY key)
  SELECT b.key, b.result_id, b.title, b.url, b.engine, round(b.score, 6) AS score, b.n_hits, coalesce(c.n_contributions, 0) AS n_contributions, coalesce(c.n_engines, 0) AS n_engines
  FROM best b LEFT JOIN counted c USING (key) WHERE n = 1""")
def merge_dedup(t):
    return discovery.merge_hits(_hits(t), "result_id", "query_id").withColumn("score", F.round("score", 6))


@query(f"WITH {_HITS} SELECT engine, count(*) AS n FROM votes GROUP BY engine ORDER BY n DESC, engine LIMIT 32")
def engine_contributions(t):
    return discovery.engine_contributions(_hits(t))


@query("SELECT query_id, count(*) AS n_hits, count(DISTINCT host) AS n_hosts, count_if(score IS NULL) AS n_unscored, max(retrieved_at) AS last_at FROM discovery_results GROUP BY query_id")
def subquery_diagnostics(t):
    return t.discovery_results.groupBy("query_id").agg(F.count("*").alias("n_hits"), F.count_distinct("host").alias("n_hosts"), F.count_if(F.col("score").isNull()).alias("n_unscored"), F.max("retrieved_at").alias("last_at"))


@query(f"""WITH lists AS (SELECT list(host) FILTER (lang = 'de') AS blocked, list(host) FILTER (lang IN ('en', 'de')) AS allowed FROM hosts),
  h AS (SELECT result_id, {_sql_host('url')} AS h FROM discovery_results)
  SELECT result_id, CASE WHEN h = '' THEN 'invalid_host' WHEN len(list_filter(blocked, lambda b: h = b OR ends_with(h, '.' || b))) > 0 THEN 'blocked_domain'
    WHEN len(list_filter(allowed, lambda b: h = b OR ends_with(h, '.' || b))) = 0 THEN 'outside_allowlist' END AS reason FROM h, lists""")
def domain_filter(t):
    hosts = t.hosts
    out = discovery.domain_decisions(t.discovery_results, hosts.filter("lang = 'de'").select("host"), hosts.filter("lang IN ('en', 'de')").select("host"))
    return out.select("result_id", F.col("filtered_reason").alias("reason"))


@query(f"""SELECT result_id, round({_sql_overlap("concat_ws(' ', coalesce(title, ''), coalesce(content, ''), coalesce(url, ''))")}, 6) AS lexical_score FROM discovery_results""")
def lexical_overlap(t):
    return discovery.with_lexical(t.discovery_results, F.lit(QUERY_TEXT)).select("result_id", F.round("lexical_score", 6).alias("lexical_score"))


@query(f"""WITH {_HITS}, s AS (SELECT *, {_sql_overlap("concat_ws(' ', coalesce(title, ''), coalesce(content, ''), coalesce(url, ''))")} AS lex FROM hits)
  SELECT result_id, url, round(score + 0.25 * lex, 6) AS rank_score FROM s ORDER BY score + 0.25 * lex DESC, score DESC, url, result_id LIMIT 50""")
def selection_order(t):
    s = discovery.with_lexical(_hits(t), F.lit(QUERY_TEXT))
    return s.orderBy(*discovery.candidate_order(), "result_id").limit(50).select("result_id", "url", F.round(F.col("score") + 0.25 * F.col("lexical_score"), 6).alias("rank_score"))


@query(f"""WITH {_HITS} SELECT result_id, query_id, host, n AS host_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, host ORDER BY score DESC, url, result_id) AS n FROM hits) WHERE n <= 2""")
def domain_cap(t):
    from pyspark.sql import Window

    w = Window.partitionBy("query_id", "host").orderBy(F.desc("score"), "url", "result_id")
    return _hits(t).withColumn("host_rank", F.row_number().over(w)).filter(F.col("host_rank") <= discovery.domain_limit(6)).select("result_id", "query_id", "host", "host_rank")


@query()
def select_urls(t):
    return discovery.select_urls(discovery.with_lexical(_hits(t), F.lit(QUERY_TEXT)), "query_id", "result_id")


# -- pages -------------------------------------------------------------------------------------------------------------

_SQUEEZE = r"trim(regexp_replace(markdown, '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))"


@query(f"""SELECT sha256({_SQUEEZE}) AS fingerprint, min(record_id) AS record_id, count(*) AS copies FROM page_cache WHERE markdown IS NOT NULL GROUP BY 1""")
def content_dedup(t):
    return pages.first_copies(t.page_cache, "markdown", "record_id")


@query(f"""SELECT record_id, CASE WHEN status_code = 429 THEN 'rate_limited'
  WHEN regexp_matches(lower((coalesce(markdown, '') || chr(10) || coalesce(raw_html, ''))[1:16384]), 'captcha|cf-chl|challenge-platform|checking your connection before continuing|please verify your browser|verify you are human|just a moment') THEN 'challenge'
  WHEN outcome = 'upstream_failure' THEN 'upstream_failure'
  WHEN kind = 'application/pdf' AND NOT coalesce(list_contains(capabilities, 'pdf'), false) THEN 'unsupported_capability'
  WHEN kind IN ('application/msword', 'application/rtf', 'application/vnd.openxmlformats-officedocument.wordprocessingml.document', 'application/vnd.oasis.opendocument.text') AND NOT coalesce(list_contains(capabilities, 'document'), false) THEN 'unsupported_capability'
  WHEN kind <> '' AND NOT (starts_with(kind, 'text/') OR kind IN ('application/xml', 'application/rss+xml', 'application/xhtml+xml', 'application/json', 'application/pdf', 'application/msword', 'application/rtf', 'application/vnd.openxmlformats-officedocument.wordprocessingml.document', 'application/vnd.oasis.opendocument.text')) THEN 'unsupported_content'
  WHEN coalesce(strlen(markdown), 0) + coalesce(strlen(raw_html), 0) > {MAX_BYTES} THEN 'content_too_large'
  WHEN coalesce(length(markdown), 0) > 0 THEN 'content'
  WHEN coalesce(contains(lower(raw_html), '<script') AND length(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw_html, '(?is)<script\\b.*?</script\\s*>', '', 'g'), '(?is)<style\\b.*?</style\\s*>', '', 'g'), '<[^>]*>', '', 'g'), '\\s+', ' ', 'g'))) < 32, false) THEN 'empty_shell'
  ELSE 'extraction_empty' END AS code FROM (SELECT *, lower(trim(split_part(content_type, ';', 1))) AS kind FROM page_cache)""")
def outcome_classify(t):
    c = F.col
    code = pages.outcome_code(c("status_code"), c("content_type"), c("markdown"), c("raw_html"), MAX_BYTES, c("capabilities"), success=c("outcome") != "upstream_failure")
    return t.page_cache.select("record_id", code.alias("code"))


@query("SELECT outcome, count(*) AS n, count_if(outcome IN ('capacity_unavailable', 'upstream_timeout', 'deadline_cancelled', 'upstream_failure', 'rate_limited')) AS n_retryable, round(avg(status_code), 4) AS mean_status FROM page_cache GROUP BY outcome")
def outcome_counts(t):
    return t.page_cache.groupBy("outcome").agg(F.count("*").alias("n"), F.count_if(F.col("outcome").isin(*pages.RETRYABLE)).alias("n_retryable"), F.round(F.avg("status_code"), 4).alias("mean_status"))


@query("SELECT host, outcome, count(*) AS n FROM page_cache GROUP BY ROLLUP (host, outcome)")
def outcome_rollup(t):
    return t.page_cache.rollup("host", "outcome").agg(F.count("*").alias("n"))


@query("SELECT record_id, cache_key, fetched_at FROM (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY fetched_at DESC NULLS LAST, record_id DESC) AS n FROM page_cache) WHERE n = 1")
def cache_upsert(t):
    return pages.latest_versions(t.page_cache.select("cache_key", "record_id", "fetched_at"), "cache_key", "fetched_at", "record_id").select("record_id", "cache_key", "fetched_at")


NOW, STALE = 1_750_000_000.0, 86_400.0


@query(f"""SELECT record_id, CASE WHEN retained_until <= {NOW} THEN 'gone' WHEN {NOW} < expires_at THEN 'fresh' WHEN {NOW} < expires_at + {STALE} THEN 'stale' ELSE 'refresh' END AS state,
  coalesce(outcome = 'content' OR (outcome = 'upstream_failure' AND status_code IN (404, 410)), false) AS cacheable,
  CASE WHEN list_contains(capabilities, 'raw_html') THEN 'raw_html_persistence_disabled' WHEN list_has_any(capabilities, ['pdf', 'document']) THEN 'unsupported_persistent_capability' END AS bypass FROM page_cache""")
def cache_states(t):
    c, now = F.col, F.lit(NOW)
    return t.page_cache.select("record_id", pages.cache_state(now, c("expires_at"), c("retained_until"), STALE).alias("state"), pages.cacheable(c("outcome"), c("status_code")).alias("cacheable"), pages.bypass_reason(c("capabilities"), True, False).alias("bypass"))


@query(f"SELECT count(*) AS n_entries, count(DISTINCT url_identity) AS n_urls, sum(coalesce(strlen(markdown), 0) + coalesce(strlen(raw_html), 0))::BIGINT AS n_bytes FROM page_cache WHERE retained_until > {NOW}")
def cache_stats(t):
    kept = t.page_cache.filter(F.col("retained_until") > NOW)
    return kept.agg(F.count("*").alias("n_entries"), F.count_distinct("url_identity").alias("n_urls"), F.sum(F.coalesce(F.octet_length("markdown"), F.lit(0)) + F.coalesce(F.octet_length("raw_html"), F.lit(0))).alias("n_bytes"))


@query(r"""SELECT record_id, line_no, section, line FROM (SELECT record_id, line_no, line,
  last_value(CASE WHEN regexp_matches(trim(line), '^#{1,6} ') THEN trim(regexp_replace(trim(line), '^#{1,6} ', '')) END IGNORE NULLS) OVER (PARTITION BY record_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS section
  FROM (SELECT record_id, unnest(l) AS line, unnest(range(len(l)))::INT AS line_no FROM (SELECT record_id, string_split(replace(replace(markdown, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS l FROM page_cache WHERE markdown IS NOT NULL))) WHERE section IS NOT NULL AND line <> ''""")
def line_sections(t):
    return pages.line_sections(t.page_cache.filter("markdown IS NOT NULL"), "record_id", "markdown").filter("section IS NOT NULL AND line <> ''").select("record_id", "line_no", "section", "line")


@query("""WITH o AS (SELECT *, lag(etag) OVER w AS pe, lag(status_code) OVER w AS ps, lag(observation_id) OVER w AS pid FROM validator_observations WINDOW w AS (PARTITION BY requested_url ORDER BY observed_at NULLS FIRST, observation_id))
  SELECT observation_id, CASE WHEN status_code IN (404, 410) AND pid IS NOT NULL AND NOT coalesce(ps IN (404, 410), false) THEN 'removed' WHEN pid IS NULL THEN 'new'
  WHEN etag IS NOT DISTINCT FROM pe AND status_code IS NOT DISTINCT FROM ps THEN 'same' ELSE 'changed' END AS change FROM o""")
def change_detection(t):
    return pages.changes(t.validator_observations, "requested_url", "observed_at", "observation_id", "etag", "status_code").select("observation_id", "change")


@query("""SELECT observation_id, baseline, coalesce(baseline <> etag, false) AS fired FROM (SELECT observation_id, etag, last_value(etag IGNORE NULLS) OVER (PARTITION BY requested_url
  ORDER BY observed_at NULLS FIRST, observation_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS baseline FROM validator_observations)""")
def watch_transition(t):
    return pages.watch_transitions(t.validator_observations, "requested_url", "observed_at", "observation_id", "etag").select("observation_id", "baseline", "fired")


@query("""WITH a AS (SELECT *, sum(CASE WHEN status_code BETWEEN 200 AND 399 THEN 1 ELSE 0 END) OVER (PARTITION BY host ORDER BY observed_at NULLS FIRST, observation_id ROWS UNBOUNDED PRECEDING) AS island FROM validator_observations),
  b AS (SELECT *, sum(CASE WHEN status_code IN (403, 429) THEN 1 ELSE 0 END) OVER (PARTITION BY host, island ORDER BY observed_at NULLS FIRST, observation_id ROWS UNBOUNDED PRECEDING)::BIGINT AS failures FROM a)
  SELECT observation_id, failures, CASE WHEN status_code IN (403, 429) THEN greatest(least(300, power(2, least(failures, 10))::INT), observation_id % 400)::BIGINT ELSE 0 END AS delay FROM b""")
def backoff_islands(t):
    o = t.validator_observations
    return pages.backoff(o, "host", "observed_at", "observation_id", "status_code", retry_after=F.col("observation_id") % 400).select("observation_id", "failures", "delay")


@query("""WITH g AS (SELECT *, greatest(3600.0, CASE WHEN host < 'm' THEN 5400.0 ELSE 0 END) + (('0x' || sha256(host)[1:4])::BIGINT) / 65535.0 * 2.5 AS gap FROM page_cache WHERE fetched_at IS NOT NULL),
  a AS (SELECT record_id, host, fetched_at, gap, row_number() OVER (PARTITION BY host ORDER BY fetched_at, record_id) - 1 AS n FROM g)
  SELECT record_id, round(max(fetched_at - n * gap) OVER (PARTITION BY host ORDER BY fetched_at, record_id ROWS UNBOUNDED PRECEDING) + n * gap - fetched_at, 2) AS waited FROM a""")
def host_schedule(t):
    robots_delay = F.when(F.col("host") < "m", 5400.0)
    gap = pages.host_spacing(F.col("host"), 3600.0, robots_delay, 2.5)
    return pages.paced_starts(t.page_cache.filter("fetched_at IS NOT NULL"), "host", F.col("fetched_at"), "record_id", gap).select("record_id", F.round("waited", 2).alias("waited"))


@query()
def version_diffs(t):
    versions = t.page_cache.filter("markdown IS NOT NULL").withColumn("article", F.concat_ws(" ", "host", "title"))
    return pages.version_diffs(versions, "article", "fetched_at", "record_id", "markdown").select("article", "record_id", "truncated", "n_previous", "n_current", F.size("added").alias("n_added"), F.size("removed").alias("n_removed"))


@query(f"""SELECT p.record_id, d.result_id, d.published_date FROM page_cache p LEFT JOIN
  (SELECT key, min(result_id) AS result_id, arg_min(published_date, result_id) AS published_date FROM (SELECT {_sql_normalize('url')} AS key, * FROM discovery_results) GROUP BY key) d ON d.key = {_sql_normalize('p.requested_url')}""")
def page_discovery_join(t):
    """Publication texts of hits for pages; every page stays, with or without a hit."""
    return discovery.attach_published(t.page_cache.select("record_id", "requested_url"), "requested_url", t.discovery_results, "result_id", "published_date").select("record_id", "result_id", "published_date")


# -- passages ----------------------------------------------------------------------------------------------------------

_NAV = ", ".join(f"'{x}'" for x in ranking.NAVIGATION)
_GEN = ", ".join(f"'{x}'" for x in ranking.GENERIC)
_LINES = r"list_filter(list_transform(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'), lambda x: lower(trim(x))), lambda x: x <> '')"
_FOOT = " OR ".join(f"contains(x, '{x}')" for x in ranking.FOOTER)
_DROP = f"""q AS (SELECT item_id, text, ln, list_transform(regexp_extract_all(text, '\\[([^\\]]+)\\]\\([^)]+\\)', 1), lambda x: lower(trim(x))) AS labels FROM (SELECT item_id, text, {_LINES} AS ln FROM evidence_quality WHERE text IS NOT NULL)),
  r AS (SELECT item_id, CASE
    WHEN length(text) <= 300 AND len(ln) >= 3 AND len(list_filter(ln, lambda x: x IN ({_NAV}))) >= 3 AND len(list_filter(ln, lambda x: x IN ({_NAV}))) / len(ln) >= 0.6 THEN 'navigation_boilerplate'
    WHEN length(text) <= 500 AND len(ln) >= 3 AND len(list_filter(ln, lambda x: {_FOOT})) >= 2 AND list_sum(list_transform(ln, lambda x: length(x))) / len(ln) < 60 THEN 'footer_boilerplate'
    WHEN len(labels) >= 6 AND length(trim(regexp_replace(text, '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g'))) < 120 AND len(list_filter(labels, lambda x: x IN ({_GEN}))) / len(labels) >= 0.8 THEN 'link_dominated' END AS reason FROM q)"""


@query(f"WITH {_DROP} SELECT item_id, reason FROM r WHERE reason IS NOT NULL")
def quality_gate(t):
    return t.evidence_quality.filter("text IS NOT NULL").select("item_id", ranking.drop_reason(F.col("text")).alias("reason")).filter("reason IS NOT NULL")


@query(f"WITH {_DROP} SELECT reason, count(*) AS n FROM r GROUP BY reason")
def quality_drop_counts(t):
    return t.evidence_quality.filter("text IS NOT NULL").groupBy(ranking.drop_reason(F.col("text")).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT passage_id, score FROM passages WHERE score > 0.5")
def relevance_floor(t):
    return t.passages.filter("score > 0.5").select("passage_id", "score")


@query("""SELECT p.passage_id, round(coalesce(p.score, m.low - 1, 0), 6) AS score FROM passages p LEFT JOIN (SELECT document_id, min(score) AS low FROM passages GROUP BY document_id) m ON m.document_id IS NOT DISTINCT FROM p.document_id""")
def floor_fill(t):
    return ranking.floor_fill(t.passages, "document_id").select("passage_id", F.round("score", 6).alias("score"))


@query("SELECT passage_id, 1.0 / row_number() OVER (PARTITION BY document_id ORDER BY passage_id) AS fallback_score FROM passages WHERE document_id IS NOT NULL")
def position_fallback(t):
    from pyspark.sql import Window

    w = Window.partitionBy("document_id").orderBy("passage_id")
    return t.passages.filter("document_id IS NOT NULL").select("passage_id", (F.lit(1.0) / F.row_number().over(w)).alias("fallback_score"))


def _scored(t):
    score = ranking.prefilter_score(F.lit(QUERY_TEXT), F.coalesce("text", F.lit("")), F.col("section_heading"), F.coalesce("start_index", F.lit(0)))
    return t.passages.withColumn("s", F.round(score, 9))


_SCORED = f"""scored AS (SELECT *, round({_sql_overlap("coalesce(text, '')")} + 0.35 * ({_sql_overlap("coalesce(section_heading, '')")}) + 1.0 / ((coalesce(start_index, 0) + 1) * 100.0), 9) AS s FROM passages)"""


@query(f"""WITH {_SCORED}, b AS (SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY s DESC, passage_id) = 1 AS best FROM scored)
  SELECT passage_id, round(s, 6) AS s FROM b ORDER BY best DESC, b.s DESC, passage_id LIMIT 50""")
def prefilter_top50(t):
    return ranking.prefilter(_scored(t), "source_url", "s", "passage_id").select("passage_id", F.round("s", 6).alias("s"))


@query("""SELECT passage_id, rank, used_tokens FROM (SELECT passage_id, row_number() OVER w AS rank, least(token_count, 120 - coalesce(sum(token_count) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS used_tokens,
  coalesce(sum(token_count) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM passages WHERE document_id IS NOT NULL AND score IS NOT NULL WINDOW w AS (PARTITION BY document_id ORDER BY score DESC, source_url, passage_id)) WHERE prior < 120""")
def token_budget_fill(t):
    p = t.passages.filter("document_id IS NOT NULL AND score IS NOT NULL")
    return ranking.token_fill(p, "document_id", [F.desc("score"), F.col("source_url"), F.col("passage_id")], 120).select("passage_id", "rank", F.col("used_tokens").cast("long").alias("used_tokens"))


@query(f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY coalesce(section_heading, '') ORDER BY score DESC NULLS LAST, passage_id) AS rank FROM passages),
  c AS (SELECT coalesce(section_heading, '') AS grp, coalesce(document_id, {_sql_normalize('source_url')}) AS citation_key, min(rank) AS first_rank, count(*) AS n_passages, count(DISTINCT (start_index, end_index)) FILTER (start_index IS NOT NULL AND end_index IS NOT NULL) AS n_spans FROM p GROUP BY 1, 2)
  SELECT grp, citation_key, first_rank, n_passages, n_spans, row_number() OVER (PARTITION BY grp ORDER BY first_rank) AS citation_id FROM c""")
def citation_groups(t):
    from pyspark.sql import Window

    p = t.passages.withColumn("grp", F.coalesce("section_heading", F.lit("")))
    p = p.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc_nulls_last("score"), "passage_id")))
    return ranking.citations(p, "grp", ranking.citation_key_of(F.col("document_id"), F.col("source_url")))


@query("""WITH RECURSIVE o AS (SELECT document_id, passage_id, strlen(text)::INT AS n_bytes, row_number() OVER (PARTITION BY document_id ORDER BY -coalesce(score, 0), source_url NULLS FIRST, passage_id) AS k FROM passages WHERE document_id IS NOT NULL AND text IS NOT NULL AND strlen(text) <= 65536),
  r AS (SELECT document_id, k, passage_id, n_bytes, n_bytes <= 1500 AS kept, CASE WHEN n_bytes <= 1500 THEN n_bytes ELSE 0 END AS used FROM o WHERE k = 1
    UNION ALL SELECT o.document_id, o.k, o.passage_id, o.n_bytes, r.used + o.n_bytes <= 1500, CASE WHEN r.used + o.n_bytes <= 1500 THEN r.used + o.n_bytes ELSE r.used END FROM r JOIN o ON o.document_id = r.document_id AND o.k = r.k + 1)
  SELECT document_id, passage_id, n_bytes FROM r WHERE kept""")
def byte_envelope(t):
    p = t.passages.filter("document_id IS NOT NULL AND text IS NOT NULL").withColumn("n_bytes", F.octet_length("text")).withColumn("neg", -F.coalesce("score", F.lit(0.0)))
    return ranking.byte_envelope(p.select("document_id", "passage_id", "neg", "source_url", "n_bytes"), "document_id", ["neg", "source_url", "passage_id"], "n_bytes", 65_536, 1_500).select("document_id", "passage_id", "n_bytes")


@query(r"""SELECT passage_id, len(regexp_extract_all(text, '[^\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+')) AS n_words FROM passages WHERE text IS NOT NULL""")
def word_counts(t):
    return t.passages.filter("text IS NOT NULL").select("passage_id", texts.word_count(F.col("text")).cast("long").alias("n_words"))


@query(r"""SELECT passage_id, regexp_extract(text, '^(\s*(?:\S+\s+){0,9}\S+)', 1) AS head FROM passages WHERE text IS NOT NULL AND text <> ''""")
def word_cut(t):
    return t.passages.filter("text IS NOT NULL AND text <> ''").select("passage_id", texts.cut_words(F.col("text"), F.lit(10)).alias("head"))
