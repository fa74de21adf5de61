import datetime as dt
import json

from pyspark.sql import functions as F

from cairn.operators import chunking, contract, discovery, html, jobs, pages, ranking, robots
from cairn.sources import search
from cairn.streaming import state, windows

HIT = "result_id long, query_id string, title string, url string, content string, engine string, engines array<string>, positions array<int>, score double"


def hits(spark, rows):
    df = spark.createDataFrame(rows, HIT)
    return discovery.with_lexical(discovery.domain_decisions(discovery.normal_hits(df, F.lit(1)), None, None), F.lit("late harbour"))


def test_hits(spark):
    rows = [(1, "q", "", "https://a.test/x", None, None, [" e ", "", "e", "f"], [3, None, 2, 0], 0.0), (2, "q", "t", " ", None, "e", None, None, 1.0), (3, "q", None, "https://a.test/x/", None, "g", [], [], None)]
    out = {r.result_id: r for r in hits(spark, rows).collect()}
    assert set(out) == {1, 3} and out[1].title == "https://a.test/x" and out[1].engine == "e" and out[1].score == 0.5
    assert [tuple(c) for c in out[1].contributions] == [("e", 3), ("f", 2)]
    merged = discovery.merge_hits(hits(spark, rows), "result_id", "query_id").collect()
    assert len(merged) == 1 and merged[0].result_id == 1 and merged[0].n_contributions == 3


def test_selection_equals_full_scan(spark):
    import random

    rng = random.Random(2)
    rows = [(k, f"q{k % 2}", "late harbour" if rng.random() < 0.5 else "x", f"https://h{rng.randrange(12)}.test/{rng.randrange(60)}", "", None, rng.sample("abcdefgh", rng.randint(1, 3)), [], round(rng.random(), 2)) for k in range(300)]
    df = hits(spark, rows).cache()
    got = {}
    for r in discovery.select_urls(df, "query_id", "result_id", 6).collect():
        got.setdefault(r.query_id, []).append((r.choice, r.result_id, r.selection_reason))
    for q in ("q0", "q1"):
        own = sorted((r for r in df.collect() if r.query_id == q), key=lambda r: (-(r.score + 0.25 * r.lexical_score), -r.score, r.url, r.result_id))
        picked = discovery.choose(((r.url, r.host, {c.engine for c in r.contributions} | {r.engine}) for r in own), 6, discovery.domain_limit(6))
        assert [(i, x) for _, i, x in sorted(got[q])] == [(own[k].result_id, x) for k, x in picked.items()]


def full_choice(rows, max_urls):
    """The greedy choice over all rows of one query."""
    own = sorted(rows, key=lambda r: (-(r.score + 0.25 * r.lexical_score), -r.score, r.url, r.result_id))
    per_host = max_urls if len({r.host for r in own}) == 1 else discovery.domain_limit(max_urls)
    picked = discovery.choose(((r.url, r.host, {c.engine for c in r.contributions} | ({r.engine} - {None})) for r in own), max_urls, per_host)
    return [(own[k].result_id, x) for k, x in picked.items()]


def chosen(df, max_urls=6):
    got = {}
    for r in discovery.select_urls(df, "query_id", "result_id", max_urls).collect():
        got.setdefault(r.query_id, []).append((r.choice, r.result_id, r.selection_reason))
    return {q: [(i, x) for _, i, x in sorted(rows)] for q, rows in got.items()}


def test_selection_engine_below_host_cap(spark):
    rows = [(k, "q", "x", f"https://a.test/{k}", "", None, ["a"], [], 0.9 - k / 100) for k in range(5)]
    rows += [(9, "q", "x", "https://a.test/9", "", None, ["b"], [], 0.5), (10, "q", "x", "https://b.test/1", "", None, ["a"], [], 0.4)]
    rows += [(20 + k, "one", "x", f"https://c.test/{k}", "", None, ["a"], [], 0.9 - k / 100) for k in range(8)]  # one host: no cap
    rows += [(40, "url", "x", "https://d.test/1", "", None, ["a"], [], 0.9), (41, "url", "x", "https://e.test/1", "", None, ["a"], [], 0.8), (42, "url", "x", "https://e.test/1", "", None, ["b"], [], 0.7)]
    got = chosen(hits(spark, rows))
    assert got["q"] == [(0, "engine_diversity"), (9, "engine_diversity"), (10, "domain_diversity")]
    assert got["one"] == [(20, "engine_diversity")] + [(k, "score") for k in range(21, 26)]
    assert got["url"] == [(40, "engine_diversity"), (42, "engine_diversity")]


def test_selection_equals_full_scan_of_table(spark):
    table = discovery.normal_hits(spark.read.parquet("/root/testdata/sf0.1/discovery_results.parquet"), F.coalesce(F.try_element_at("positions", F.lit(1)), F.lit(1)))
    df = discovery.with_lexical(table, F.lit("weekly harbour report near the library")).select("query_id", "result_id", "url", "host", "engine", "contributions", "score", "lexical_score").cache()
    groups = {}
    for r in df.collect():
        groups.setdefault(r.query_id, []).append(r)
    for max_urls in (6, 20):
        assert chosen(df, max_urls) == {q: full_choice(rows, max_urls) for q, rows in groups.items()}


def test_limits():
    assert [discovery.domain_limit(n) for n in (1, 2, 3, 6, 20)] == [1, 1, 1, 2, 3] and discovery.domain_limit(9, 1) == 9


def test_quality(spark):
    cases = {
        "Home\nSearch\nLogin": "navigation_boilerplate",
        "Privacy Policy\nCopyright 2020\nx": "footer_boilerplate",
        " ".join(f"[{w}](u)" for w in ("one", "two", "next", "Read more", "five", "six")): "link_dominated",
        "A sound text.": None,
        "": None,
        None: None,
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: r.reason for r in df.withColumn("reason", ranking.drop_reason(F.col("t"))).collect()} == cases


def test_budget_and_envelope(spark):
    df = spark.createDataFrame([("d", k, n, 1.0) for k, n in enumerate([50, 60, 30, 10])], "g string, k int, token_count int, score double")
    used = [(r.k, r.used_tokens) for r in ranking.token_fill(df, "g", [F.col("k")], 120).orderBy("k").collect()]
    assert used == [(0, 50), (1, 60), (2, 10)]
    fits = ranking.byte_envelope(df, "g", ["k"], "token_count", 55, 65).collect()
    assert sorted(r.k for r in fits) == [0, 3]
    assert spark.createDataFrame([("aé",), (None,)], "t string").select(ranking.cut_utf8(2)("t").alias("x")).collect()[0].x == "a"


def test_pages(spark):
    t = dt.datetime(2024, 1, 1)
    obs = spark.createDataFrame([("u", 1, t, "a", 200), ("u", 2, t, "a", 200), ("u", 3, None, "b", 200), ("u", 4, t, None, 404), ("v", 5, t, None, 200)], "u string, i long, at timestamp, tag string, code int")
    assert {r.i: r.change for r in pages.changes(obs, "u", "at", "i", "tag", "code").collect()} == {3: "new", 1: "changed", 2: "same", 4: "removed", 5: "new"}
    fired = {r.i: (r.baseline, r.fired) for r in pages.watch_transitions(obs, "u", "at", "i", "tag").collect()}
    assert fired[1] == ("b", True) and fired[4] == ("a", False) and fired[5] == (None, False)
    paced = pages.paced_starts(spark.createDataFrame([("h", k, a) for k, a in enumerate([0.0, 1.0, 9.0])], "h string, i int, a double"), "h", F.col("a"), "i", 4.0)
    assert [r.start_at for r in paced.orderBy("i").collect()] == [0.0, 4.0, 9.0]
    assert pages.diff_lines("a\nb", "a\nc\r\nd")["added"] == ["c", "d"] and pages.diff_lines("a", "a") is None
    assert pages.diff_lines("a\nb\nc", None, 2)["truncated"] and pages.first_copies(obs.filter("false"), "tag", "i").count() == 0


def test_chunking(spark):
    text = "One two three. Four five six seven.\n\nEight nine. " + "word " * 30
    spans = chunking.segments(text, 5)
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    chunks = chunking.chunk(text, None, 12, 4, 5)
    assert chunks and max(c[2] for c in chunks) <= 12 and chunks[0][0] == 0 and chunks[-1][1] == len(text)
    assert chunking.chunk(" \n ") == [] and chunking.chunk(None) == [] and chunking.chunk("x" * 5000)[0][2] == 1
    assert chunking.greedy_groups([3, 3, 3], 6, 1) == [(0, 2), (2, 3)]


def test_dp_is_best():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    v, sizes = rng.normal(size=(7, 4)), [3, 2, 4, 1, 2, 3, 2]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    sim = v @ v.T

    def value(cut):
        edges = [0, *cut, 7]
        total = 0.0
        for a, b in zip(edges, edges[1:], strict=False):
            if sum(sizes[a:b]) > 8:
                return None
            total += sum(sim[i, j] for i in range(a, b) for j in range(i + 1, b))
        return total

    best = max(x for n in range(7) for c in itertools.combinations(range(1, 7), n) if (x := value(c)) is not None)
    got = chunking.best_groups(v, sizes, 8, 1)
    assert abs(value([a for a, _ in got[1:]]) - best) < 1e-9


def test_watch_reads_whole_page(spark):
    filler = "<p>x</p>" * ((1 << 20) // 8 + 1)
    rows = [(1, f"<body>{filler}<h1>Late</h1></body>"), (2, f"<body><h1>A</h1>{filler}<h1>B</h1></body>"), (3, "<body><h1>A</h1></body>"), (4, None)]
    got = {r.i: r.state for r in html.watch(spark.createDataFrame(rows, "i long, h string"), "i", "h", css="h1").collect()}
    assert got == {1: "found", 2: "ambiguous", 3: "found", 4: "missing"}


def test_robots_group_without_rules(spark):
    star = "User-agent: *\nDisallow: /\n\nUser-agent: "
    files = spark.createDataFrame([("h.test", star + "cairn\nDisallow:\n"), ("d.test", star + "cairn\nCrawl-delay: 3\n"), ("o.test", star + "other\nDisallow:\n"), ("e.test", "")], "o string, b string")
    rules = robots.robots_rules(files, "o", "b")
    urls = spark.createDataFrame([(k, f"https://{h}.test/x") for k, h in enumerate("hdoe")], "i long, u string")
    assert {r.i: r.allowed for r in robots.robots_decisions(urls, "i", "u", rules, "o", "cairn").collect()} == {0: True, 1: True, 2: False, 3: True}
    assert [r.crawl_delay for r in rules.filter("o = 'd.test' AND agent = 'cairn'").collect()] == [3.0]


def test_robots_and_sitemaps(spark):
    body = "User-agent: a\nUser-agent: b\nDisallow: /x # c\nAllow: /x/y\nCrawl-delay: 5\n\nUser-agent: *\nDisallow: /\n"
    rules = robots.robots_rules(spark.createDataFrame([("h.test", body), ("g.test", None)], "o string, b string"), "o", "b")
    urls = spark.createDataFrame([(1, "https://h.test/x"), (2, "https://h.test/x/y/z"), (3, "https://h.test/"), (4, "https://g.test/x")], "i int, u string")
    assert {r.i: r.allowed for r in robots.robots_decisions(urls, "i", "u", rules, "o", "A").collect()} == {1: False, 2: True, 3: True, 4: True}
    assert {r.i: r.allowed for r in robots.robots_decisions(urls, "i", "u", rules, "o", "other").collect()}[3] is False
    xml = "<html><pre><urlset><url><loc>u</loc><lastmod>2024-01-01</lastmod></url><url><loc/></url></urlset></pre>"
    assert robots.parse_sitemap(xml)[1] == [("u", "2024-01-01", None, 0)] and robots.parse_sitemap("<!DOCTYPE x><urlset/>")[2] == "unsafe_xml"


def test_frontier(spark):
    links = spark.createDataFrame([("https://a.test/1", "https://a.test/2"), ("https://a.test/2", "https://a.test/3?utm_x=1"), ("https://a.test/3", "https://a.test/1"), ("https://a.test/3", "https://a.test/4")], "source string, target string")
    seeds = spark.createDataFrame([("https://a.test/1#x",)], "url string")
    assert {r.key[-1]: r.depth for r in robots.frontier(seeds, links, 2).collect()} == {"1": 0, "2": 1, "3": 2}


def test_jobs(spark):
    r = spark.createDataFrame([("s", 1, "f", 1), ("s", 1, "f", 2), ("s", 1, "g", 3), (None, 1, "f", 4)], "s string, k int, f string, n int")
    assert [x.claim for x in jobs.claims(r, "s", "k", "f", ["n"]).orderBy("n").collect()] == ["created", "replayed", "conflict", "created"]
    e = spark.createDataFrame([("j", "cancel_requested", 1), ("j", "completed", 2), ("j", "failed", 3), ("i", "failed", 1)], "j string, st string, n int")
    assert {x.j: x.final_state for x in jobs.final_state(e, "j", "st", ["n"]).collect()} == {"j": "cancelled", "i": "failed"}


PAGE = """<html lang="EN"><head><title>T</title><meta name="author" content="A"><link rel="canonical" href="/c">
<script type="application/ld+json">{"@graph":[{"@type":"Article","headline":"H","author":[{"name":"B"}]}]}</script></head>
<body><h2>S</h2><p>x</p><a href="/in" title="t">in</a><a href="https://o.test/">out</a><a href="mailto:x">m</a><div hidden><a href="/no">no</a></div>
<table><tr><th colspan="2">h</th></tr><tr><td>1<td>2</tr></table><p class="a b" id="i" data-k="v">target</p>"""


def test_html():
    tree = html.Tree(PAGE).root
    found = html.links(tree, "https://a.test/p")
    assert [(x[0], x[4]) for x in found] == [("https://a.test/in", False), ("https://o.test/", True)] and PAGE[found[0][5] : found[0][6]] == '<a href="/in" title="t">in</a>'
    assert [x[4] for x in html.tables(tree)][:1] == ["h"] and html.tables(tree)[0][6] == 2
    assert ("author", "B", "json_ld") in html.metadata(tree, "https://a.test/p") and ("declared_canonical_url", "https://a.test/c", "html_canonical") in html.metadata(tree, "https://a.test/p")
    assert html.locate(tree, css="p.a#i[data-k=v]")[:2] == ("found", "target") and html.locate(tree, css="p")[0] == "ambiguous"
    assert html.locate(tree, text="x", section="S")[0] == "found" and html.locate(tree, css="p > a")[0] == "unsupported" and html.locate(tree, role="link", name="OUT")[0] == "found"
    assert html.links(html.Tree("<a href='x'<b>").root, "") == [] and html.Tree("").root.children == []


def test_contract(spark):
    schema = {"type": "object", "properties": {"a": {"type": "integer"}, "b": {"type": "array", "items": {"type": "string"}}}, "required": ["a"]}
    contract.check_schema(schema)
    assert contract.failures(schema, {"b": [1], "c": 2}) == [("/a", "required_missing"), ("/c", "additional_property"), ("/b/0", "type_mismatch")]
    assert contract.leaves({"x/y": [1, {"~": None}]}) == [("/x~1y/0", 1), ("/x~1y/1/~0", None)]
    assert contract.supports(5, "about 5 of") and contract.supports(True, "Yes!") and not contract.supports("", "x")
    df = spark.createDataFrame([(1, json.dumps({"a": 3}), json.dumps({"/a": "has 3"}), "it has 3"), (2, "{", "{}", "x"), (3, json.dumps({"a": 4}), "{}", "x")], "i int, d string, e string, m string")
    assert {r.i: r.status for r in contract.evidence_fields(df, "i", "d", "e", "m", schema).collect()} == {1: "ok", 2: "invalid_json", 3: "unsupported"}


def test_recorded_search(spark, tmp_path):
    (tmp_path / "q1.json").write_text(json.dumps({"results": [{"url": "u", "engines": ["e"]}, {"url": ""}], "unresponsive_engines": [["x"], 3]}))
    (tmp_path / "q2.json").write_text(json.dumps({"results": [{"url": 5}]}))
    search.register(spark)
    rows = spark.read.format("recorded_search").load(str(tmp_path)).collect()
    assert [(r.subquery, r.url, r.engine, r.score) for r in rows] == [("q1", "u", "e", 1.0)]
    assert search.parse_failures({"unresponsive_engines": [["x"], 3, ["y", "slow"]]}) == [("x", "unresponsive"), ("y", "slow")]


def test_streams(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    events = spark.createDataFrame([("h", t + dt.timedelta(minutes=k), k, c, 1.0) for k, c in enumerate([429, 429, 200, 403])], "host string, ts timestamp, event_id long, status_code int, value double")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for name, df in (("backoff", state.host_backoff(stream)), ("tumble", windows.tumbling(stream, "ts", "2 minutes", "host", "value"))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    got = [(r.event_id, r.failures, r.delay) for r in spark.table("backoff").orderBy("event_id").collect()]
    batch = pages.backoff(events, "host", "ts", "event_id", "status_code").orderBy("event_id").collect()
    assert got == [(0, 1, 2), (1, 2, 4), (2, 0, 0), (3, 1, 2)] == [(r.event_id, r.failures, r.delay) for r in batch]
    assert spark.table("tumble").columns == ["window_start", "host", "n", "total"]


def test_cache_stream(spark, tmp_path):
    rows = spark.createDataFrame([("k", 0.0, 1), ("k", 5.0, 2), ("k", 12.0, 3), ("k", 30.0, 4)], "key string, at double, event_id long")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = state.cache_reads(stream, 10, 5, 60).writeStream.format("memory").queryName("reads").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    q.stop()
    assert [r.state for r in spark.table("reads").orderBy("event_id").collect()] == ["refresh", "fresh", "stale", "refresh"]
