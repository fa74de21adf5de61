"""Queries over requests, reasons, statistics, rerank joins and response budgets, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import identity, texts, url
from cairn.operators import discovery, jobs, pages, ranking, robots, serving, store
from cairn.plans.evidence_queries import NOW, QUERY_TEXT, STALE, _hits, _sql_host, _sql_normalize, _sql_part
from cairn.plans.registry import query

_STATE = f"CASE WHEN retained_until <= {NOW} THEN 'gone' WHEN {NOW} < expires_at THEN 'fresh' WHEN {NOW} < expires_at + {STALE} THEN 'stale' ELSE 'refresh' END"


def _state():
    return pages.cache_state(F.lit(NOW), F.col("expires_at"), F.col("retained_until"), STALE)


# -- requests ----------------------------------------------------------------------------------------------------------


@query("""SELECT request_id, coalesce(nullif(params.max_chunk_tokens, 0), CASE WHEN source_type = 'WEB_MARKDOWN' THEN 8000 END, 4000)::BIGINT AS token_budget,
  least(coalesce(nullif(params.overlap_tokens, 0), CASE WHEN source_type = 'WEB_MARKDOWN' THEN 12 END, 6), 20)::BIGINT AS max_urls FROM chunk_requests""")
def request_limits(t):
    profile = lambda n: F.when(F.col("source_type") == "WEB_MARKDOWN", n)
    budget, urls = serving.limit(F.col("params.max_chunk_tokens"), profile(8000), 4000), serving.limit(F.col("params.overlap_tokens"), profile(12), 6, 20)
    return t.chunk_requests.select("request_id", budget.cast("long").alias("token_budget"), urls.cast("long").alias("max_urls"))


@query("""SELECT q.query_id, p.pos::INT AS pos, p.s AS subquery FROM (SELECT query_id, min(title) AS text FROM discovery_results WHERE title IS NOT NULL AND query_id IS NOT NULL GROUP BY query_id) q,
  (SELECT unnest([0, 1, 2]) AS pos) n, LATERAL (SELECT n.pos AS pos, (string_split(q.text, ' '))[n.pos + 1][1:8] AS s) p WHERE n.pos < len(string_split(q.text, ' '))""")
def planned_queries(t):
    """A planner that asks for each word; the first three, cut to eight characters."""
    q = t.discovery_results.filter("title IS NOT NULL AND query_id IS NOT NULL").groupBy("query_id").agg(F.min("title").alias("text"))
    return serving.planned_queries(q, "query_id", "text", lambda text: text.split(" "), 3, 8)


@query("""WITH l AS (SELECT list(host ORDER BY host) FILTER (lang = 'de') AS ob, list(host ORDER BY host) FILTER (lang IN ('fr', 'de')) AS rb, list(host ORDER BY host) FILTER (lang IN ('en', 'de')) AS oa, list(host ORDER BY host) FILTER (date_order = 'dmy') AS ra FROM hosts)
  SELECT list_sort(list_distinct(ob || rb)) AS blocked, list_sort(list_intersect(ra, oa)) AS allowed FROM l""")
def effective_lists(t):
    pick = lambda c: F.array_sort(F.collect_set(F.when(F.expr(c), F.col("host"))))
    lists = t.hosts.agg(pick("lang = 'de'").alias("ob"), pick("lang IN ('fr', 'de')").alias("rb"), pick("lang IN ('en', 'de')").alias("oa"), pick("date_order = 'dmy'").alias("ra"))
    blocked, allowed = serving.effective_lists(F.col("ob"), F.col("rb"), F.col("oa"), F.col("ra"), True)
    return lists.select(F.array_sort(blocked).alias("blocked"), F.array_sort(allowed).alias("allowed"))


@query(f"""SELECT crawl_id, h <> '' AND NOT (h = 'dreibror-post.example' OR ends_with(h, '.dreibror-post.example')) AND (ends_with(h, '.example') OR h = 'example') AS ok FROM (SELECT crawl_id, {_sql_host('requested_url')} AS h FROM crawl_results)""")
def operator_gate(t):
    names = lambda *x: F.array(*[F.lit(n) for n in x])
    return t.crawl_results.select("crawl_id", serving.operator_allows("requested_url", names("Dreibror-Post.example."), names("example"), True).alias("ok"))


@query("""SELECT record_id, list_sort(list_filter(list_distinct(coalesce(capabilities, [])), lambda c: c NOT IN ('markdown', 'links', 'metadata'))) AS missing FROM page_cache""")
def capability_filter(t):
    return t.page_cache.select("record_id", serving.unsupported(F.col("capabilities"), ("markdown", "links", "metadata")).alias("missing"))


@query(f"""SELECT entry_id, s <> '' AND h <> '' AND (s = 'https' AND h = 'dreibror-post.example' OR ends_with(h, '.dreibror-post.example')) AS ok
  FROM (SELECT entry_id, lower({_sql_part('sitemap_url', 1)}) AS s, {_sql_host('sitemap_url')} AS h FROM sitemap_entries)""")
def sitemap_scope(t):
    return t.sitemap_entries.select("entry_id", serving.sitemap_allowed("sitemap_url", "https://dreibror-post.example/a", True).alias("ok"))


@query("""SELECT record_id, CASE WHEN list_contains(capabilities, 'markdown') THEN markdown END AS markdown, CASE WHEN list_contains(capabilities, 'raw_html') THEN raw_html END AS raw_html,
  CASE WHEN list_contains(capabilities, 'links') THEN links END AS links FROM page_cache WHERE outcome = 'content'""")
def fetch_projection(t):
    gated = lambda c, cap: F.when(F.array_contains("capabilities", cap), F.col(c)).alias(c)
    return t.page_cache.filter("outcome = 'content'").select("record_id", gated("markdown", "markdown"), gated("raw_html", "raw_html"), gated("links", "links"))


@query("""SELECT p.record_id, p.seen, c.n_pages FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY record_id) = 1 AS seen FROM page_cache WHERE document_id IS NOT NULL) p
  JOIN (SELECT document_id, count(DISTINCT passage_id) AS n_pages FROM passages WHERE document_id IS NOT NULL GROUP BY 1) c USING (document_id) WHERE p.seen""")
def citation_page_join(t):
    """Cited documents with their page (the first of its id), inner."""
    first = t.page_cache.filter("document_id IS NOT NULL").groupBy("document_id").agg(F.min("record_id").alias("record_id"))
    cited = t.passages.filter("document_id IS NOT NULL").groupBy("document_id").agg(F.count_distinct("passage_id").alias("n_pages"))
    return cited.join(first, "document_id").select("record_id", F.lit(True).alias("seen"), "n_pages")


# -- reasons and statistics --------------------------------------------------------------------------------------------


@query("""SELECT record_id, CASE WHEN outcome IN ('unsafe_target', 'unsafe_redirect', 'robots_refused', 'upstream_timeout', 'deadline_cancelled', 'malformed_upstream_response', 'rate_limited', 'local_processing_failure') THEN outcome ELSE 'upstream_failure' END AS reason FROM page_cache WHERE outcome <> 'content'""")
def site_reasons(t):
    return t.page_cache.filter("outcome <> 'content'").select("record_id", serving.site_reason(F.col("outcome"), F.lit(False)).alias("reason"))


@query("""SELECT query_id, CASE WHEN n = 0 THEN 'no_results_from_discovery' WHEN scored = 0 THEN 'no_urls_after_selection' WHEN listed = 0 THEN 'all_crawls_failed' WHEN ranked = 0 THEN 'no_chunks_after_dedup' WHEN dated = 0 THEN 'no_chunks_after_rerank' WHEN titled = 0 THEN 'no_evidence_after_quality_gate' WHEN high = 0 THEN 'no_evidence_after_output_budget' END AS reason
  FROM (SELECT query_id, count(*) AS n, count(score) AS scored, count(engines) AS listed, count_if(positions[1] <= 5) AS ranked, count(published_date) AS dated, count_if(title <> '') AS titled, count_if(score > 3) AS high FROM discovery_results GROUP BY query_id)""")
def empty_reasons(t):
    counts = t.discovery_results.groupBy("query_id").agg(
        F.count("*").alias("a"), F.count("score").alias("b"), F.count("engines").alias("c"), F.count_if(F.try_element_at("positions", F.lit(1)) <= 5).alias("d"), F.count("published_date").alias("e"), F.count_if(F.col("title") != "").alias("f"), F.count_if(F.col("score") > 3).alias("g")
    )
    return counts.select("query_id", serving.empty_reason(*[F.col(c) for c in "abcdefg"]).alias("reason"))


@query("SELECT DISTINCT trim(label) AS engine, status_code::VARCHAR AS reason FROM validator_observations WHERE label IS NOT NULL AND status_code IS NOT NULL ORDER BY 1, 2 LIMIT 32")
def engine_failures(t):
    return serving.engine_failures(t.validator_observations.select(F.trim("label").alias("engine"), F.col("status_code").cast("string").alias("reason")), "engine", "reason")


@query(f"""SELECT host, count_if(outcome = 'content') AS succeeded, count_if(outcome IS DISTINCT FROM 'content') AS failed, count_if({_STATE} = 'fresh') AS n_fresh, count_if({_STATE} = 'stale') AS n_stale, count_if({_STATE} = 'refresh') AS n_refresh FROM page_cache GROUP BY host""")
def fetch_stats(t):
    return serving.fetch_stats(t.page_cache, ["host"], F.col("outcome"), _state())


@query("SELECT host, CASE WHEN bool_or(coalesce(strlen(markdown) > 6000, false)) THEN 'limit_reached' WHEN bool_or(outcome <> 'content') THEN 'partial' ELSE 'completed' END AS site_outcome FROM page_cache GROUP BY host")
def site_outcomes(t):
    return serving.site_outcome(t.page_cache, ["host"], F.octet_length("markdown") > 6000, F.col("outcome") != "content")


@query("SELECT document_id, bool_or(score IS NULL) AS degraded, arg_min(trust, passage_id) AS strategy FROM passages WHERE trust IS NOT NULL GROUP BY document_id")
def degraded_flags(t):
    return serving.degraded(t.passages.filter("trust IS NOT NULL"), ["document_id"], F.col("score").isNull(), "trust", "passage_id")


@query("""SELECT document_id, sum(used)::BIGINT AS tokens FROM (SELECT document_id, least(token_count, 120 - coalesce(sum(token_count) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS used,
  coalesce(sum(token_count) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM passages WHERE document_id IS NOT NULL AND score IS NOT NULL WINDOW w AS (PARTITION BY document_id ORDER BY score DESC, source_url, passage_id)) WHERE prior < 120 GROUP BY document_id""")
def token_totals(t):
    p = t.passages.filter("document_id IS NOT NULL AND score IS NOT NULL")
    return ranking.token_fill(p, "document_id", [F.desc("score"), F.col("source_url"), F.col("passage_id")], 120).groupBy("document_id").agg(F.sum("used_tokens").cast("long").alias("tokens"))


@query("""SELECT record_id, array_to_string(CASE WHEN outcome = 'robots_refused' THEN ['discovered', 'filtered'] ELSE ['discovered', 'queued', CASE WHEN outcome = 'content' THEN 'fetched' ELSE 'failed' END] END, ',') AS states FROM page_cache""")
def terminal_marks(t):
    """Records of which refused ones are terminal before the fetch, so that its mark changes nothing."""
    before = F.when(F.col("outcome") == "robots_refused", F.array(F.lit("discovered"), F.lit("filtered"))).otherwise(F.array(F.lit("discovered"), F.lit("queued")))
    states = F.when(F.col("outcome") == "content", serving.marked(before, "fetched")).otherwise(serving.marked(before, "failed"))
    return t.page_cache.select("record_id", F.array_join(states, ",").alias("states"))


@query(f"""WITH s AS (SELECT host, min(requested_url) AS url FROM page_cache GROUP BY host),
  p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY requested_url ORDER BY fetched_at DESC, record_id DESC) AS n FROM page_cache) WHERE n = 1)
  SELECT s.host, coalesce(p.final_url, s.url) AS effective_url, CASE WHEN s.host < 'c' THEN 'unsafe_seed' WHEN p.record_id IS NULL THEN 'deadline_cancelled' WHEN p.outcome IN ('rate_limited', 'robots_refused') THEN p.outcome WHEN p.outcome <> 'content' THEN 'upstream_failure'
    WHEN regexp_matches({_sql_part('s.url', 3)}, '^/dienst/') THEN 'robots_refused' END AS reason FROM s LEFT JOIN p ON p.requested_url = s.url""")
def seed_preparation(t):
    p = t.page_cache
    seeds = p.groupBy("host").agg(F.min("requested_url").alias("url"))
    rules = robots.robots_rules(t.hosts.select(F.col("host").alias("origin"), F.lit("User-agent: *\nDisallow: /dienst/").alias("body")), "origin", "body")
    decided = robots.robots_decisions(seeds, "url", "url", rules, "origin", "cairn")
    out = serving.prepared_seeds(seeds, p.select("requested_url", "final_url", "outcome", "fetched_at", "record_id"), "url", F.col("host") >= "c", decided)
    return out.select("host", "effective_url", "reason")


@query(f"""WITH k AS (SELECT {_sql_normalize('url')} AS key, 'sitemap' AS source, 0 AS depth FROM sitemap_entries UNION ALL SELECT {_sql_normalize('requested_url')}, 'link', 1 FROM crawl_results UNION ALL SELECT {_sql_normalize('url')}, 'search', 0 FROM discovery_results)
  SELECT key, min(depth) AS depth, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM k GROUP BY key""")
def frontier_sources(t):
    """The frontier fed by sitemaps, links and a search of the site."""
    rows = lambda df, c, source, depth: df.select(url.normalize_url(c).alias("key"), F.lit(source).alias("source"), F.lit(depth).alias("depth"))
    fed = rows(t.sitemap_entries, "url", "sitemap", 0).unionByName(rows(t.crawl_results, "requested_url", "link", 1)).unionByName(rows(t.discovery_results, "url", "search", 0))
    return serving.merged_sources(fed, "key", "source", "depth")


# -- selection ---------------------------------------------------------------------------------------------------------


@query()
def selection_decisions(t):
    """Every candidate of each query with its reason: selected, or left out by the cap of its host or by its rank."""
    return discovery.selection_decisions(discovery.with_lexical(_hits(t), F.lit(QUERY_TEXT)), "query_id", "result_id").select("query_id", "result_id", "selected", "selection_reason", "filtered_reason")


def _reported(t):
    decided = discovery.selection_decisions(discovery.with_lexical(_hits(t), F.lit(QUERY_TEXT)), "query_id", "result_id")
    return serving.diagnostics(decided, "query_id", ["result_id"], 5, 900)


@query()
def url_diagnostics(t):
    return _reported(t).filter("kept").select("query_id", "result_id", "selected", "n_bytes")


@query()
def diagnostic_omissions(t):
    return serving.omissions(_reported(t), "query_id")


# -- rerank and budgets ------------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT passage_id, document_id, (n // 4)::INT AS batch, (n % 4)::INT AS index FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY passage_id) - 1 AS n FROM passages WHERE document_id IS NOT NULL)),
  r AS (SELECT document_id, batch, (passage_id * 7 % 6)::INT AS index, round((passage_id * 37 % 101) / 100.0, 2)::DOUBLE AS score, passage_id FROM c WHERE batch % 3 <> 2),
  f AS (SELECT document_id, batch, index, arg_min(score, passage_id) AS score FROM r GROUP BY ALL),
  j AS (SELECT c.*, f.score FROM c LEFT JOIN f USING (document_id, batch, index))
  SELECT passage_id, score IS NOT NULL AS scored, round(coalesce(score, min(score) OVER (PARTITION BY document_id) - 1), 6) AS score FROM j""")
def rerank_scores(t):
    """Answers of a reranker with repeated and impossible places, and every third batch lost."""
    chunks = serving.numbered(t.passages.filter("document_id IS NOT NULL").select("passage_id", "document_id"), "document_id", ["passage_id"], 4)
    answers = chunks.filter("batch % 3 <> 2").select("document_id", "batch", (F.col("passage_id") * 7 % 6).cast("int").alias("index"), F.round((F.col("passage_id") * 37 % 101) / 100.0, 2).alias("score"), "passage_id")
    return serving.rerank_join(chunks, answers, "document_id", "passage_id").select("passage_id", "scored", F.round("score", 6).alias("score"))


@query()
def reranked(t):
    """Token overlap as a scorer over batches of passages."""

    def score(query: str, found: list[str]) -> list[float]:
        wanted = set(query.lower().split())
        return [len(wanted & set(x.lower().split())) / len(wanted) for x in found]

    p = t.passages.filter("document_id IS NOT NULL").select("passage_id", "document_id", "text")
    return serving.reranked(p, "document_id", QUERY_TEXT, "text", ["passage_id"], score, 8).select("passage_id", "scored", F.round("score", 6).alias("score"))


@query()
def record_budgets(t):
    e = t.sitemap_entries.select("host", "entry_id", "url", "priority")
    return serving.record_budget(e, "host", ["entry_id"], F.to_json(F.struct("url", "priority")), 2_000).filter("kept").select("host", "entry_id", "n_bytes")


@query()
def fitted_items(t):
    return t.passages.filter("text IS NOT NULL").select("passage_id", F.length(serving.fit_text(200)("text")).alias("n_chars"))


@query()
def shrunk_links(t):
    return t.page_cache.filter("links IS NOT NULL").select("record_id", serving.shrink_json(120)("links").alias("s")).select("record_id", "s.*")


@query()
def bounded_metadata(t):
    return t.page_cache.filter("metadata IS NOT NULL").select("record_id", serving.bounded_copy(4, 60)("metadata").alias("metadata"))


@query("""SELECT crawl_id, pos::INT AS pos, u AS url FROM (SELECT *, row_number() OVER (PARTITION BY crawl_id, u ORDER BY pos) AS n FROM (SELECT job_id, min(crawl_id) AS crawl_id, unnest(list(requested_url ORDER BY crawl_id DESC)) AS u, unnest(range(count(*))) AS pos FROM crawl_results GROUP BY job_id)) WHERE n = 1""")
def result_order(t):
    """Results of jobs brought back to the order of the request's URLs."""
    r = t.crawl_results
    wanted = r.groupBy("job_id").agg(F.min("crawl_id").alias("crawl_id"), F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("crawl_id", "requested_url")))), lambda x: x["requested_url"]).alias("urls"))
    got = r.join(wanted.select("job_id", F.col("crawl_id").alias("first")), r["job_id"].eqNullSafe(wanted["job_id"])).select(F.col("first").alias("crawl_id"), F.col("requested_url").alias("url")).distinct()
    return serving.in_request_order(got, wanted, "crawl_id", "urls", "url").select("crawl_id", "pos", "url")


@query("""SELECT conflict_id, list_transform(candidates, lambda c: CASE WHEN c.source = 'html_meta' THEN 'replaced' ELSE c.value END) AS vals FROM metadata_conflicts WHERE candidates IS NOT NULL""")
def schema_composition(t):
    """One element of an array of extractions replaced by its kind."""
    m = t.metadata_conflicts.filter("candidates IS NOT NULL")
    new = F.struct(F.lit("replaced").alias("value"), F.lit("html_meta").alias("source"), F.lit(None).cast("string").alias("confidence"))
    return m.select("conflict_id", F.transform(serving.replaced(F.col("candidates"), "source", "html_meta", new), lambda c: c["value"]).alias("vals"))


@query("SELECT query_id, count(*) AS n_urls, sum(CASE WHEN engine IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_failed, sha256(query_id)[1:16] AS query_hash FROM discovery_results WHERE query_id IS NOT NULL GROUP BY query_id")
def search_summaries(t):
    """The counter record that a search logs; the query only as a hash."""
    d = t.discovery_results.filter("query_id IS NOT NULL").groupBy("query_id").agg(F.count("*").alias("n_urls"), F.count_if(F.col("engine").isNull()).alias("n_failed"))
    return d.withColumn("query_hash", identity.short_hash(F.col("query_id")))


@query("""SELECT request_id, trim(regexp_replace(CASE WHEN source_type = 'WEB_MARKDOWN' THEN regexp_replace(regexp_replace(text, '(?m)^[\\t-\\r ]*!\\[[^\\]]*\\]\\([^)]*\\)[\\t-\\r ]*$', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g') ELSE text END, '^[\\t-\\r ]+|[\\t-\\r ]+$', '', 'g')) AS clean FROM chunk_requests WHERE text IS NOT NULL AND regexp_matches(text, '^[\\x00-\\x{24ff}]*$')""")
def precleaned(t):
    r = t.chunk_requests.filter(F.col("text").isNotNull() & F.col("text").rlike(r"^[\x00-\x{24ff}]*$"))
    return r.select("request_id", texts.preclean(F.col("text"), F.col("source_type")).alias("clean"))


@query("""SELECT p.passage_id, bool_or(coalesce(substring(d.markdown, p.start_index + 1, p.end_index - p.start_index) = p.text, false)) AS exact FROM passages p JOIN page_cache d ON d.document_id = p.document_id WHERE p.text IS NOT NULL AND p.start_index IS NOT NULL GROUP BY p.passage_id""")
def exact_spans(t):
    """Whether a passage stands in a page of its document where it says."""
    p = t.passages.filter("text IS NOT NULL AND start_index IS NOT NULL AND document_id IS NOT NULL").select("passage_id", "text", "start_index", "end_index", "document_id")
    held = F.coalesce(F.expr("substring(markdown, start_index + 1, end_index - start_index)") == F.col("text"), F.lit(False))
    return p.join(t.page_cache.select("document_id", "markdown"), "document_id").groupBy("passage_id").agg(F.bool_or(held).alias("exact"))


@query("""SELECT source_type, count_if(ok) AS n_ok, count_if(NOT ok) AS n_rejected, CASE WHEN count_if(ok) = 0 THEN 'unavailable' WHEN count_if(NOT ok) > 0 THEN 'partial' ELSE 'ok' END AS status
  FROM (SELECT source_type, coalesce(regexp_matches(text, '\\S') AND strlen(text) <= 20000, false) AS ok FROM chunk_requests) GROUP BY source_type""")
def chunk_fanout(t):
    """Requests that the chunker takes or rejects one by one; a source is unavailable only if all are rejected."""
    ok = F.coalesce(F.col("text").rlike(r"\S") & (F.octet_length("text") <= 20_000), F.lit(False))
    out = t.chunk_requests.groupBy("source_type").agg(F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_rejected"))
    return out.withColumn("status", F.when(F.col("n_ok") == 0, "unavailable").when(F.col("n_rejected") > 0, "partial").otherwise("ok"))


# -- jobs --------------------------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT requested_url AS job, observed_at AS a, observation_id AS b, CASE WHEN status_code = 200 THEN 'completed' WHEN status_code IN (404, 410) THEN 'failed' WHEN status_code = 304 THEN 'cancel_requested' ELSE 'running' END AS state FROM validator_observations WHERE observed_at IS NOT NULL),
  t AS (SELECT job, min({'a': a, 'b': b, 'state': state}) AS t FROM e WHERE state IN ('completed', 'failed') GROUP BY job), c AS (SELECT job, min({'a': a, 'b': b}) AS c FROM e WHERE state = 'cancel_requested' GROUP BY job)
  SELECT t.job, CASE WHEN c.c IS NOT NULL AND (c.c.a < t.t.a OR c.c.a = t.t.a AND c.c.b < t.t.b) THEN 'cancelled' ELSE t.t.state END AS final_state FROM t LEFT JOIN c USING (job)""")
def job_final_state(t):
    state = F.when(F.col("status_code") == 200, "completed").when(F.col("status_code").isin(404, 410), "failed").when(F.col("status_code") == 304, "cancel_requested").otherwise("running")
    events = t.validator_observations.filter("observed_at IS NOT NULL").select(F.col("requested_url").alias("job"), F.col("observed_at").alias("at"), F.col("observation_id").alias("id"), state.alias("state"))
    return jobs.final_state(events, "job", "state", ["at", "id"])


@query("SELECT host, arg_min(crawl_id, {'a': received_at, 'b': crawl_id}) AS crawl_id FROM crawl_results WHERE received_at IS NOT NULL GROUP BY host")
def next_job(t):
    """The oldest queued job of each scope."""
    return jobs.next_queued(t.crawl_results.filter("received_at IS NOT NULL"), "host", ["received_at", "crawl_id"], "crawl_id")


@query("""SELECT observation_id, attempt, least(30.0, 1.5 * power(2, least(attempt - 1, 20))) AS wait FROM (SELECT observation_id, row_number() OVER (PARTITION BY requested_url ORDER BY observed_at NULLS FIRST, observation_id) AS attempt FROM validator_observations WHERE status_code >= 400)""")
def job_retries(t):
    failed = t.validator_observations.filter("status_code >= 400")
    return jobs.retries(failed, "requested_url", [F.asc_nulls_first("observed_at"), F.col("observation_id")], 1.5, 30.0).select("observation_id", "attempt", "wait")


@query("""SELECT j.job_id, count(r.crawl_id) AS n_results, max(r.received_at) AS last_at, CASE WHEN max(r.received_at) < TIMESTAMP '2025-02-01' THEN 'expired' ELSE 'running' END AS state FROM (SELECT DISTINCT job_id FROM crawl_results WHERE job_id IS NOT NULL) j LEFT JOIN crawl_results r USING (job_id) GROUP BY j.job_id""")
def job_reads(t):
    r = t.crawl_results.filter("job_id IS NOT NULL")
    return jobs.read_jobs(r.select("job_id").distinct(), r, "job_id", "crawl_id", "received_at", F.lit("2025-02-01").cast("timestamp"))


# -- store -------------------------------------------------------------------------------------------------------------


@query(f"""SELECT record_id, source_hash, (expires_at - fetched_at)::DOUBLE AS ttl, (retained_until - fetched_at)::DOUBLE AS kept, raw_html IS NULL AS bare FROM (
  SELECT record_id, sha256(coalesce(markdown, '')) AS source_hash, {NOW} AS fetched_at, {NOW} + 86400 AS expires_at, {NOW} + 2592000 AS retained_until, NULL AS raw_html FROM page_cache WHERE outcome = 'content' OR (outcome = 'upstream_failure' AND status_code IN (404, 410)))""")
def cache_record_build(t):
    built = store.build_records(t.page_cache, F.col("cache_key"), url.cache_identity("requested_url"), F.lit(NOW), 86_400.0, 2_592_000.0, "clean@2", False)
    return built.select("record_id", "source_hash", (F.col("expires_at") - F.col("fetched_at")).alias("ttl"), (F.col("retained_until") - F.col("fetched_at")).alias("kept"), F.col("raw_html").isNull().alias("bare"))


@query(f"""SELECT o.observation_id, c.record_id, c.record_id IS NOT NULL AS hit FROM validator_observations o LEFT JOIN (SELECT * FROM (SELECT requested_url, record_id, row_number() OVER (PARTITION BY requested_url ORDER BY fetched_at DESC, record_id DESC) AS n FROM page_cache WHERE retained_until > {NOW}) WHERE n = 1) c USING (requested_url)""")
def cache_lookup(t):
    cache = t.page_cache.select("requested_url", "record_id", "fetched_at", "retained_until")
    return store.lookup(t.validator_observations.select("observation_id", "requested_url"), cache, "requested_url", NOW).select("observation_id", "record_id", "hit")


def _targets(t):
    p = t.page_cache.filter("title IS NOT NULL")
    return p.select("cache_key", F.md5("title").alias("locator_hash"), F.lit("found").alias("resolution"), F.col("title").alias("text"), F.col("fetched_at").alias("updated_at"))


_SQL_TARGETS = "SELECT cache_key, md5(title) AS locator_hash, title AS text, max(fetched_at) AS updated_at FROM page_cache WHERE title IS NOT NULL GROUP BY ALL"


@query(f"SELECT cache_key, locator_hash, text, updated_at FROM ({_SQL_TARGETS})")
def target_upsert(t):
    rows = _targets(t)
    return store.upsert(store.empty_cache(rows), rows, ["cache_key", "locator_hash"], "updated_at").select("cache_key", "locator_hash", "text", "updated_at")


@query(f"""SELECT s.cache_key, s.locator_hash, c.record_id FROM ({_SQL_TARGETS}) s JOIN (SELECT cache_key, arg_max(record_id, {{'a': fetched_at, 'b': record_id}}) AS record_id FROM page_cache WHERE retained_until > {NOW} GROUP BY cache_key) c USING (cache_key)""")
def target_lookup(t):
    rows = store.upsert(store.empty_cache(_targets(t)), _targets(t), ["cache_key", "locator_hash"], "updated_at")
    return store.targets_of(rows, t.page_cache, NOW).select("cache_key", "locator_hash", "record_id")


@query(f"""SELECT record_id FROM page_cache WHERE cache_key NOT IN (SELECT cache_key FROM page_cache WHERE outcome = 'rate_limited' AND cache_key IS NOT NULL) AND url_identity NOT IN (SELECT url_identity FROM page_cache WHERE status_code = 404 AND url_identity IS NOT NULL) AND retained_until > {NOW}""")
def cache_delete(t):
    p = t.page_cache
    return store.deleted(p, p.filter("outcome = 'rate_limited'"), p.filter("status_code = 404"), NOW).select("record_id")


@query(f"""SELECT record_id, v IS NOT NULL AND record_id % 3 = 0 AS refreshed, CASE WHEN v IS NOT NULL AND record_id % 3 = 0 THEN {NOW} + 86400 ELSE expires_at END AS expires_at, retained_until FROM (
  SELECT *, CASE WHEN NOT coalesce(list_contains(capabilities, 'javascript'), false) AND len(list_filter(map_entries(response_headers), lambda e: lower(e.key) IN ('etag', 'last-modified') AND e.value <> '')) > 0 THEN 1 END AS v FROM page_cache)""")
def conditional_refresh(t):
    asked = store.validators(F.col("response_headers"), F.col("capabilities")).isNotNull()
    answer = F.when(asked, F.when(F.col("record_id") % 3 == 0, 304).otherwise(200))
    return store.revalidated(t.page_cache, answer, F.lit(NOW), 86_400.0).select("record_id", "refreshed", "expires_at", "retained_until")


@query("""WITH n AS (SELECT requested_url, max(fetched_at) AS at FROM page_cache GROUP BY 1), r AS (SELECT observation_id, requested_url, observed_at, CASE WHEN observation_id % 2 = 0 THEN 1e12 END AS baseline FROM validator_observations),
  f AS (SELECT requested_url, min({'a': observed_at, 'b': observation_id}).b AS first FROM r WHERE observed_at IS NOT NULL GROUP BY 1)
  SELECT r.observation_id, CASE WHEN n.at > coalesce(r.baseline, -1e300) THEN 'reuse' WHEN r.observation_id = f.first THEN 'fetch' ELSE 'wait' END AS action FROM r LEFT JOIN n USING (requested_url) JOIN f USING (requested_url) WHERE r.observed_at IS NOT NULL""")
def coalesced_refresh(t):
    requests = t.validator_observations.filter("observed_at IS NOT NULL").select("observation_id", "requested_url", "observed_at", F.when(F.col("observation_id") % 2 == 0, F.lit(1e12)).alias("baseline_at"))
    return store.refresh_decisions(requests, t.page_cache, "requested_url", "observation_id", "observed_at").select("observation_id", "action")


@query(f"SELECT cache_key, min(record_id) AS record_id FROM page_cache WHERE {_STATE} = 'stale' AND cache_key IS NOT NULL GROUP BY cache_key")
def background_refresh(t):
    """One refresh task per stale key."""
    return t.page_cache.filter((_state() == "stale") & F.col("cache_key").isNotNull()).groupBy("cache_key").agg(F.min("record_id").alias("record_id"))


@query(f"SELECT host, min(retained_until) AS wake_at FROM page_cache WHERE retained_until > {NOW} GROUP BY host")
def retention_wake(t):
    """When the next record of each host ends its retention."""
    return t.page_cache.filter(F.col("retained_until") > NOW).groupBy("host").agg(F.min("retained_until").alias("wake_at"))


@query(f"SELECT record_id FROM page_cache WHERE fetched_at IS NOT NULL AND fetched_at + CASE WHEN outcome = 'content' THEN 86400 ELSE 60 END > {NOW} - 40000000")
def robots_ttl(t):
    s = t.page_cache.withColumn("state", F.when(F.col("outcome") == "content", "available").otherwise("unreachable"))
    return store.robots_fresh(s, NOW - 40_000_000, 86_400.0).select("record_id")


@query(f"""SELECT record_id, coalesce(NOT regexp_matches({_sql_part('requested_url', 3)}, '^/dienst/'), false) AND (final_url IS NULL OR coalesce(NOT regexp_matches({_sql_part('final_url', 3)}, '^/dienst/'), false)) AS allowed FROM page_cache""")
def cache_robots_gate(t):
    p = t.page_cache
    urls = p.select(F.explode(F.array("requested_url", "final_url")).alias("url")).filter("url IS NOT NULL").distinct()
    rules = robots.robots_rules(t.hosts.select(F.col("host").alias("origin"), F.lit("User-agent: *\nDisallow: /dienst/").alias("body")), "origin", "body")
    return store.cache_use_allowed(p, robots.robots_decisions(urls, "url", "url", rules, "origin", "cairn"), ["requested_url", "final_url"]).select("record_id", "allowed")


@query("""SELECT record_id, sha256('{"capabilities":[' || array_to_string(list_transform(list_sort(capabilities), lambda c: '"' || c || '"'), ',') || '],"cleaner_version":"' || cleaner_version || '","retrieval_variant":"browser","url":"' || url_identity || '","version":"cache-identity@1"}') AS key
  FROM page_cache WHERE url_identity IS NOT NULL AND capabilities IS NOT NULL AND cleaner_version IS NOT NULL""")
def cache_keys(t):
    p = t.page_cache.filter("url_identity IS NOT NULL AND capabilities IS NOT NULL AND cleaner_version IS NOT NULL")
    return p.select("record_id", identity.cache_key(F.col("url_identity"), F.col("capabilities"), "browser", F.col("cleaner_version")).alias("key"))


@query("""SELECT record_id, source_hash = sha256(markdown) AS hash_ok, document_id IS NULL OR regexp_full_match(document_id, '[0-9a-f]{64}') AS id_ok, expires_at >= fetched_at AND retained_until >= expires_at AS times_ok FROM page_cache WHERE markdown IS NOT NULL""")
def identity_checks(t):
    """Constraints between derived ids and what they derive from."""
    p = t.page_cache.filter("markdown IS NOT NULL")
    return p.select("record_id", (F.col("source_hash") == identity.source_hash(F.col("markdown"))).alias("hash_ok"), (F.col("document_id").isNull() | F.col("document_id").rlike("^[0-9a-f]{64}$")).alias("id_ok"), ((F.col("expires_at") >= F.col("fetched_at")) & (F.col("retained_until") >= F.col("expires_at"))).alias("times_ok"))
