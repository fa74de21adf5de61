"""Serving, store and extension points: what SQL cannot express against brute force on small tables."""

import json

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from cairn import interfaces
from cairn.operators import chunking, contract, discovery, html, pages, ranking, serving, store
from cairn.plans import job_queries, registry, serving_queries
from cairn.streaming import state

assert job_queries and serving_queries


def run(spark, name):
    return registry.QUERIES[name](spark, DATA)


def decisions(rows, max_urls=6, allowed=None):
    """rows in order: (id, url, host, engines) -> id -> (selected, reason), straight from the rules."""
    limit = max_urls if len({r[2] for r in rows}) <= 1 else discovery.domain_limit(max_urls, allowed)
    picked = discovery.choose([(r[1], r[2], r[3]) for r in rows], max_urls, limit)
    hosts = {}
    for k in picked:
        hosts[rows[k][2]] = hosts.get(rows[k][2], 0) + 1
    urls = {rows[k][1] for k in picked}
    out = {}
    for k, r in enumerate(rows):
        if k in picked:
            out[r[0]] = (True, picked[k])
        elif r[1] not in urls:
            out[r[0]] = (False, "domain_cap" if hosts.get(r[2], 0) >= limit else "rank_cap")
    return out


def test_selection_decisions(spark):
    got = {r.result_id: (r.selected, r.selection_reason or r.filtered_reason) for r in run(spark, "selection_decisions").collect()}
    hits = discovery.with_lexical(discovery.normal_hits(spark.read.parquet(f"{DATA}/discovery_results.parquet"), F.coalesce(F.try_element_at("positions", F.lit(1)), F.lit(1))), F.lit("weekly harbour report near the library"))
    groups = {}
    for r in hits.select("query_id", "result_id", "url", "host", "score", "lexical_score", "engine", "contributions").collect():
        groups.setdefault(r.query_id, []).append(r)
    expected = {}
    for rows in groups.values():
        rows.sort(key=lambda r: (-(r.score + 0.25 * r.lexical_score), -r.score, r.url, r.result_id))
        expected |= decisions([(r.result_id, r.url, r.host, {c.engine for c in r.contributions} | ({r.engine} if r.engine else set())) for r in rows])
    assert got == expected and {"domain_cap", "rank_cap"} <= {v for _, v in got.values()}


def test_diagnostics_and_omissions(spark):
    rows = run(spark, "url_diagnostics").collect()
    full = {(r.query_id, r.result_id): r for r in run(spark, "selection_decisions").collect()}
    by_query = {}
    for r in rows:
        by_query.setdefault(r.query_id, []).append(r)
    assert all(len(v) <= 5 and 2 + sum(r.n_bytes for r in v) + len(v) - 1 <= 900 for v in by_query.values())
    omitted = sum(r.n for r in run(spark, "diagnostic_omissions").collect())
    assert omitted + len(rows) == len(full) and omitted > 0
    selected = {k for k, r in full.items() if r.selected}
    assert {(r.query_id, r.result_id) for r in rows if r.selected} <= selected


def test_envelope_marks(spark):
    df = spark.createDataFrame([("g", k, n) for k, n in enumerate([5, 90, 5, None, 5, 5])], "g string, k int, n int")
    kept = ranking.byte_envelope(df, "g", ["k"], "n", 50, 20, 3, 2, 1, "kept").orderBy("k").collect()
    assert [r.kept for r in kept] == [True, False, True, False, True, False]


def test_rerank_failing_batch(spark):
    df = spark.createDataFrame([("g", k, "a b" if k % 2 else None) for k in range(6)] + [("h", 9, "bad")], "g string, k int, t string")

    def scorer(query, found):
        if "bad" in found:
            raise RuntimeError("no answer")
        return [float(len(t)) for t in found[:1]]

    got = {r.k: (r.score, r.scored) for r in serving.reranked(df, "g", "q", "t", ["k"], scorer, 2).collect()}
    assert got == {0: (0.0, True), 1: (-1.0, False), 2: (0.0, True), 3: (-1.0, False), 4: (0.0, True), 5: (-1.0, False), 9: (None, False)}
    assert run(spark, "reranked").filter("scored").count() > 0


def test_fit_and_shrink(spark):
    for text in ("", "plain", 'quo"tes and \\ and \n' * 9, "äöü€😀" * 20):
        for most in (2, 3, 10, 57):
            fits = [n for n in range(len(text) + 1) if len(json.dumps(text[:n], ensure_ascii=False).encode()) <= most]
            expected = text if fits and fits[-1] == len(text) else (text[: fits[-1]] or None) if fits else None
            assert serving.fitted_text(text, most) == expected
    out, omitted = serving.shrunk({"a": ["x" * 30, "y"], "b": [1, 2, 3]}, 30)
    assert out == {"a": [], "b": [1, 2, 3]} and omitted == 2 and serving.shrunk({"a": []}, 1) == ({"a": []}, 0)
    df = spark.createDataFrame([('{"a": [1, 2]}',), ("[]",), ("{",), (None,), ('{"a": 1}',)], "j string")
    assert [r.s.json for r in df.select(serving.shrink_json(10)("j").alias("s")).collect()] == ['{"a": [1]}', None, None, None, None]
    assert run(spark, "fitted_items").filter("n_chars > 200").count() == 0
    assert run(spark, "shrunk_links").filter("octet_length(json) > 120").count() == 0 and run(spark, "record_budgets").groupBy("host").agg(F.sum("n_bytes").alias("n")).filter("n > 2000").count() == 0


def test_bounded_json(spark):
    assert serving.bounded_json('{"b": 1, "a": {"d": [1, 2], "c": null}}') == '{"a":{"c":null,"d":[1,2]},"b":1}'
    assert serving.bounded_json('{"b": 1, "a": {"d": [1, 2]}}', most_items=3) == '{"a":{"d":[1]}}'
    assert serving.bounded_json('{"b": 1, "a": "xxxxxxxxxxxx"}', most_bytes=10) == "{}" and serving.bounded_json("[1]") is None and serving.bounded_json(None) is None
    assert serving.bounded_json('{"a": {"b": {"c": 1}}}', most_depth=2) == '{"a":{}}'
    assert run(spark, "bounded_metadata").filter("octet_length(metadata) > 60").count() == 0


def test_overlap_and_force_split(spark):
    text = "x" * 25 + " " + "yy " * 10
    pieces = chunking.force_split(text, 10)
    assert "".join(pieces) == text and max(map(len, pieces)) <= 10 and chunking.force_split("", 5) == []
    sizes = [3, 3, 3, 3, 9, 3]
    ranges = chunking.overlapping(sizes, 9, 3)
    assert ranges == [(0, 3), (2, 4), (4, 5), (5, 6)] and chunking.overlapping([], 5, 1) == []
    assert all(sum(sizes[a:b]) <= 9 for a, b in ranges) and ranges[0][0] == 0 and ranges[-1][1] == len(sizes)
    rows = run(spark, "overlap_chunks").collect()
    assert rows and all(r.end_index > r.start_index for r in rows)


def test_long_documents_are_grouped_alike():
    text = ". ".join(f"Word{k % 7} and some more of it number {k}" for k in range(2500))
    assert {c[3] for c in chunking.chunk(text, None, 40, 5, 8)} == {"semantic-dp"}
    assert {c[3] for c in chunking.chunk(text, None, 40, 5, 8, max_segments=2000)} == {"greedy-semantic"}
    assert {c[3] for c in chunking.chunk(text, None, 40, 5, 8, embed=lambda x: 1 / 0)} == {"greedy-tokens"}


def test_html_without_bounds(spark):
    body = "".join(f"<a href='/p{k}'>{k}</a>" for k in range(250)) + "".join(f"<table>{'<tr><td>x</td></tr>' * 120}</table>" for _ in range(22)) + "".join(f"<meta name='author' content='A{k}'>" for k in range(60))
    df = spark.createDataFrame([(1, body + " " * (1 << 20) + "<a href='/last'>z</a>", "https://a.test/")], "id long, h string, u string")
    whole, bounded = html.extract(df, "id", "h", "u").first(), html.extract(df, "id", "h", "u", html.SERVICE_LIMITS).first()
    assert (whole.status, len(whole.links), len(whole.cells), len(whole.candidates)) == ("ok", 251, 22 * 120, 60)
    assert (bounded.status, len(bounded.links), len(bounded.cells), len(bounded.candidates)) == ("truncated", 100, 2000, 8)


def test_diffs_without_bounds(spark):
    old = "\n".join(f"line {k}" for k in range(5000))
    found = pages.diff_lines(old, old.replace("line 2500\n", "line x\nline y\n"))
    assert (found["added"], found["removed"], found["truncated"]) == (["line x", "line y"], ["line 2500"], False)
    df = spark.createDataFrame([("u", 1, 1.0, "a\nb"), ("u", 2, 2.0, "a\nb"), ("u", 3, 3.0, "a\nc"), ("u", 4, 4.0, None), ("v", 5, 1.0, "z")], "u string, i long, at double, t string")
    got = {r.i: (r.added, r.removed) for r in pages.version_diffs(df, "u", "at", "i", "t").collect()}
    assert got == {3: (["c"], ["b"]), 4: ([], ["a", "c"])}


@pytest.mark.parametrize(
    "bad",
    [[], {"type": "string"}, {"type": "object"}, {"type": "object", "properties": {"a": {"type": "null"}}}, {"type": "object", "properties": {"a": {"type": "array"}}}, {"type": "object", "properties": {}, "required": ["x"]},
     {"type": "object", "properties": {"a": {"type": "string", "enum": [1]}}}, {"type": "object", "properties": {"a": {"type": "string", "description": "x" * 2000}}}, {"type": "object", "properties": {"a\n": {"type": "string"}}},
     {"type": "object", "properties": {"x": {"type": "object", "properties": {f"p{k}": {"type": "string"} for k in range(20)}}, "y": {"type": "object", "properties": {f"p{k}": {"type": "string"} for k in range(20)}}}}],
)
def test_schema_rules(bad):
    with pytest.raises(ValueError):
        contract.check_schema(bad)


def test_all_failures_are_listed():
    schema = {"type": "object", "properties": {"a": {"type": "array", "items": {"type": "integer"}}}}
    assert len(contract.failures(schema, {"a": ["x"] * 50})) == 50 and len(contract.failures(schema, {"a": ["x"] * 50}, 32)) == 32


def test_store(spark, tmp_path):
    rows = spark.createDataFrame([("k", "l", "old", 1.0)], "cache_key string, locator_hash string, text string, updated_at double")
    fresh = spark.createDataFrame([("k", "l", "new", 1.0), ("k", "m", "other", None)], rows.schema)
    both = store.upsert(rows, fresh, ["cache_key", "locator_hash"], "updated_at")
    assert {(r.locator_hash, r.text) for r in both.collect()} == {("l", "new"), ("m", "other")}
    assert store.empty_cache(rows).count() == 0 and store.empty_cache(rows).schema == rows.schema
    assert store.cascade(both, rows.filter("false")).count() == 0
    with pytest.raises(ValueError):
        store.robots_fresh(rows, 0.0, 0.0)
    state.write_pages_and_targets(fresh.select("cache_key", F.lit(1.0).alias("at"), F.lit(1).alias("id")), fresh, str(tmp_path), 3)
    state.write_pages_and_targets(fresh.select("cache_key", F.lit(1.0).alias("at"), F.lit(1).alias("id")), fresh, str(tmp_path), 3)  # a repeated batch replaces itself
    assert spark.read.parquet(f"{tmp_path}/pages").count() == 1 and spark.read.parquet(f"{tmp_path}/targets").count() == 2


def test_extension_points(spark, tmp_path):
    for name, protocol in (("planner", interfaces.QueryPlanner), ("discovery", interfaces.SearchDiscovery), ("selection", interfaces.SelectionPolicy), ("extractor", interfaces.ContentExtractor), ("structured", interfaces.StructuredDataExtractor), ("cache", interfaces.PageCacheRepository), ("cleaner", interfaces.MarkdownCleaner), ("chunker", interfaces.SemanticChunker), ("prefilter", interfaces.CandidatePrefilter), ("reranker", interfaces.Reranker), ("assembler", interfaces.ResultAssembler), ("embedding", interfaces.EmbeddingFunction), ("text_chunker", interfaces.BaseChunker)):
        assert isinstance(getattr(interfaces.DEFAULT, name), protocol), name
    (tmp_path / "q1.json").write_text(json.dumps({"results": [{"url": "https://a.test/", "title": "A"}]}))
    asked = spark.createDataFrame([("q1", str(tmp_path)), ("q2", str(tmp_path))], "subquery string, folder string")
    assert [r.url for r in interfaces.DEFAULT.discovery(asked).collect()] == ["https://a.test/"]
    schema = {"type": "object", "properties": {"n": {"type": "integer"}}}
    df = spark.createDataFrame([(1, "it has 3 of them"), (2, None)], "id int, m string")
    found = interfaces.structured_fields(df, "id", "m", schema, lambda text, s: ('{"n": 3}', '{"/n": "has 3"}'))
    assert {(r.id, r.status) for r in found.collect()} == {(1, "ok"), (2, "unsupported")}
    assert {r.status for r in interfaces.structured_fields(df, "id", "m", schema).collect()} == {"invalid_json"}
