"""Queries over cleaning, fetch joins, headers, strategies and redirects."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import identity
from cairn.operators import chunking, cleaning, robots
from cairn.plans.evidence_queries import _sql_netloc, _sql_part, _sql_query
from cairn.plans.registry import query
from cairn.sources import search

_KEPT = r"list_filter(list_transform(string_split(replace(markdown, chr(13), ''), chr(10)), lambda x: rtrim(x)), lambda x: NOT regexp_matches(x, '^\s*[*+-]?\s*(\[[^\]]*\]\(/[^)]*\)\s*[|·]?\s*)+$') AND NOT regexp_matches(x, '^[^.!?]*(›| · )[^.!?]*$'))"


@query(rf"""SELECT host, sum(length(markdown))::BIGINT AS chars_before, sum(length(trim(regexp_replace(array_to_string({_KEPT}, chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'))))::BIGINT AS chars_after,
  sum(len(string_split(markdown, chr(10))) - len({_KEPT}))::BIGINT AS lines_dropped, count(*) AS n_pages FROM page_cache WHERE markdown IS NOT NULL GROUP BY host""")
def cleaning_totals(t):
    return cleaning.totals(t.page_cache.filter("markdown IS NOT NULL"), "markdown", "host")


@query(rf"""WITH a AS (SELECT host, unnest(list_transform(string_split(replace(markdown, chr(13), ''), chr(10)), lambda x: rtrim(x))) AS line FROM page_cache WHERE markdown IS NOT NULL), b AS (SELECT host, unnest({_KEPT}) AS line FROM page_cache WHERE markdown IS NOT NULL)
  SELECT host, count(*) AS n FROM (SELECT host, line FROM a EXCEPT ALL SELECT host, line FROM b) GROUP BY host""")
def multiset_removed(t):
    """Lines that cleaning removes, with multiplicity, per host."""
    p = t.page_cache.filter("markdown IS NOT NULL")
    before = p.select("host", F.explode(F.transform(F.split(F.regexp_replace("markdown", "\r", ""), "\n"), lambda x: F.rtrim(x))).alias("line"))
    after = p.select("host", F.explode(cleaning.kept_lines(F.col("markdown"))).alias("line"))
    return cleaning.removed_lines(before, after).groupBy("host").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY requested_url ORDER BY fetched_at DESC, record_id DESC) AS k FROM page_cache) WHERE k = 1)
  SELECT o.observation_id, coalesce(p.outcome, 'deadline_cancelled') AS outcome, p.record_id FROM validator_observations o LEFT JOIN p USING (requested_url)""")
def fetch_join(t):
    pages = t.page_cache.select("requested_url", "record_id", "outcome", "fetched_at")
    return search.fetch(t.validator_observations.select("observation_id", "requested_url"), pages).select("observation_id", "outcome", "record_id")


@query("""WITH e AS (SELECT record_id, unnest(map_entries(response_headers)) AS e FROM page_cache),
  f AS (SELECT record_id, lower(e.key) AS name, first(e.value ORDER BY e.key) AS v FROM e GROUP BY 1, 2)
  SELECT p.record_id, max(CASE WHEN name = 'content-type' AND strlen(v) <= 1024 THEN v END) AS content_type, max(CASE WHEN name = 'etag' AND strlen(v) <= 1024 THEN v END) AS etag,
    max(CASE WHEN name = 'last-modified' AND strlen(v) <= 1024 THEN v END) AS last_modified, max(CASE WHEN name = 'retry-after' AND strlen(v) <= 1024 THEN v END) AS retry_after FROM page_cache p LEFT JOIN f USING (record_id) GROUP BY p.record_id""")
def header_allowlist(t):
    return t.page_cache.select("record_id", search.allowed_headers(F.col("response_headers")).alias("h")).select("record_id", "h.*")


@query("""WITH s AS (SELECT request_id, CASE WHEN params.max_chunk_tokens > 0 THEN params.max_chunk_tokens ELSE 400 END AS largest, CASE WHEN params.min_chunk_tokens > 0 THEN params.min_chunk_tokens ELSE 50 END AS low,
  CASE WHEN params.initial_segment_tokens > 0 THEN params.initial_segment_tokens ELSE 50 END AS seg FROM chunk_requests) SELECT request_id, largest, least(low, largest) AS smallest, least(seg, largest) AS segment FROM s""")
def strategy_params(t):
    c = F.col
    top, low, segment = chunking.strategy_columns(c("strategy_version"), c("params.max_chunk_tokens"), c("params.min_chunk_tokens"), c("params.initial_segment_tokens"))
    return t.chunk_requests.select("request_id", top.alias("largest"), low.alias("smallest"), segment.alias("segment"))


_KEY = "lower({0}) || '://' || {1} || {2} || CASE WHEN {3} = '' THEN '' ELSE '?' || {3} END"


def _key(col: str) -> str:
    return _KEY.format(_sql_part(col, 1), _sql_netloc(col), _sql_part(col, 3), _sql_query(col))


@query(f"SELECT {_key('final_url')} AS final_key, min({_key('requested_url')}) AS first_key, count(*) AS n FROM page_cache WHERE final_url IS NOT NULL GROUP BY 1")
def redirect_merge(t):
    return robots.redirect_merge(t.page_cache.filter("final_url IS NOT NULL"), "requested_url", "final_url")


@query("SELECT sha256(query_id)[1:16] AS query_hash, count(*) AS n, count(DISTINCT host) AS n_hosts FROM discovery_results WHERE query_id IS NOT NULL GROUP BY 1")
def search_log(t):
    return t.discovery_results.filter("query_id IS NOT NULL").groupBy(identity.short_hash(F.col("query_id")).alias("query_hash")).agg(F.count("*").alias("n"), F.count_distinct("host").alias("n_hosts"))


@query("SELECT kind, key, n FROM (SELECT 'outcome' AS kind, outcome AS key, count(*) AS n FROM page_cache GROUP BY outcome UNION ALL SELECT 'label', lower(trim(label)), count(*) FROM validator_observations GROUP BY lower(trim(label)))")
def state_summary(t):
    a = t.page_cache.groupBy(F.lit("outcome").alias("kind"), F.col("outcome").alias("key")).agg(F.count("*").alias("n"))
    return a.unionByName(t.validator_observations.groupBy(F.lit("label").alias("kind"), F.lower(F.trim("label")).alias("key")).agg(F.count("*").alias("n")))
