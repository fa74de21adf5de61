import json

from pyspark.sql import functions as F

from cairn.operators import nested

SCHEMA = "crawl_id long, payload string, result_pos string"


def rows(spark, payloads):
    df = spark.createDataFrame([(k, p, "x") for k, p in enumerate(payloads)], SCHEMA)
    return sorted(map(tuple, nested.crawl_fields(df).collect()))


def test_fields(spark):
    full = {"results": [5, {"links": {"internal": [{"href": "/a"}, "/b", None, {"href": " "}, {"href": "/a"}]}, "metadata": {"title": "T"}, "response_headers": {"ETag": "x"}}, None]}
    lone = {"links": {"internal": {"href": "/c"}}, "metadata": [{"title": "no"}], "response_headers": {"etag": 5}}
    got = rows(spark, [json.dumps(full), json.dumps(json.dumps(lone)), None, "", "{", "[1]", json.dumps({"results": []}), "NaN"])
    assert got == [
        (0, 1, "links.internal.href", 0, "/a"), (0, 1, "links.internal.href", 1, "/b"), (0, 1, "links.internal.href", 4, "/a"),
        (0, 1, "metadata.title", -1, "T"), (0, 1, "response_headers.etag", -1, "x"), (1, 0, "links.internal.href", 0, "/c"),
    ]


def brute_fields(payload):
    """Rows of one payload, read straight from the definition."""
    value = nested.decode(payload)
    if not isinstance(value, dict):
        return
    results = value.get("results")
    for k, r in enumerate(results if isinstance(results, list) else [value]):
        branch = lambda name, r=r: r[name] if isinstance(r, dict) and isinstance(r.get(name), dict) else {}
        internal = branch("links").get("internal")
        for j, x in enumerate(internal if isinstance(internal, list) else [internal]):
            yield k, "links.internal.href", j, x.get("href") if isinstance(x, dict) else x
        yield k, "metadata.title", -1, branch("metadata").get("title")
        for name, x in branch("response_headers").items():
            if name.lower() == "etag":
                yield k, "response_headers.etag", -1, x


ODD = [
    [[{"metadata": {"title": "in"}, "links": {"internal": [{"href": "/in"}]}}]], [{"metadata": {"title": ["x"]}}], [{"response_headers": {"ETag": ["x"]}}], [{"response_headers": {"etag": [["x"]]}}],
    [{"links": {"internal": [{"href": ["/x"]}]}}], [{"links": {"internal": {"href": [{"href": "/x"}]}}}], [{"links": {"internal": [["/x", {"href": "/y"}]]}}], [{"links": [{"internal": ["/x"]}]}],
    [{"metadata": [{"title": "x"}]}], [{"response_headers": [{"etag": "x"}]}], [{"links": {"internal": [{"href": {"href": "/x"}}]}}], [{"metadata": {"title": {"title": "x"}}}],
]


def test_odd_shapes_beside_normal(spark):
    whole = {"links": {"internal": [{"href": "/a"}, "/b", {"href": "/c"}]}, "metadata": {"title": "T"}, "response_headers": {"ETag": "x", "etag": "y"}}
    normal = [{"results": [whole, 3, whole]}, {**whole, "links": {"internal": {"href": "/d"}}}]
    for odd in [*([x] for x in ODD), ODD]:
        payloads = [json.dumps(x) for x in (*normal, *({"results": x} for x in odd))]
        expected = sorted((k, *r) for k, p in enumerate(payloads) for r in brute_fields(p) if isinstance(r[-1], str) and r[-1].strip())
        assert rows(spark, payloads) == expected and len(expected) >= 16, odd


def test_fields_of_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/crawl_results.parquet").select("crawl_id", "payload")
    expected = sorted((i, *r) for i, p in table.collect() for r in brute_fields(p) if isinstance(r[-1], str) and r[-1].strip())
    assert sorted(map(tuple, nested.crawl_fields(table).collect())) == expected and len(expected) > 10_000


def test_empty(spark):
    assert rows(spark, []) == [] and rows(spark, [None, "x"]) == []


def test_deep_and_recursive(spark):
    value = {"a": [{"b": [[1, 2], [3]], "c": {"d": "x"}}, {"b": [], "c": {"d": "y", "e": [{"f": 1}]}}]}
    df = spark.createDataFrame([(1, json.dumps(value)), (1, json.dumps(value))], "id long, j string")
    plan = nested.plan_tables(nested.schema_graph(df, "j"))
    assert {"a", "a[].b", "a[].c.e"} <= plan.repeated and plan.parent("a[].c.e") == "a"
    shredded = nested.shred(df, "id", "j", plan)
    flat = nested.flat_table(shredded, "a", ["c.d"])
    assert sorted((r.pos[0], r.c_d) for r in flat.collect()) == [(0, "x"), (0, "x"), (1, "y"), (1, "y")]
    rows = shredded.collect()
    keys = {(r.path, tuple(r.pos)) for r in rows}
    assert all(r.path == "" or (r.parent_path, tuple(r.pos[:-1])) in keys for r in rows)


def test_shared_and_recursive(spark):
    person = {"name": "n", "mail": "m"}
    tree = {"part": {"id": 1, "part": {"id": 2, "part": {"id": 3}}}}
    df = spark.createDataFrame([(1, json.dumps({"author": person, "review": {"author": person}, **tree, "a.b": 1}))], "rid long, j string")
    plan = nested.plan_tables(nested.schema_graph(df, "j"))
    assert {p: plan.table(p) for p in plan.repeated} == {"author": "author", "review.author": "author", "part": "part", "part.part": "part", "part.part.part": "part"}
    rows = nested.shred(df, "rid", "j", plan)
    authors = nested.flat_table(rows, "author", ["name"]).collect()
    assert sorted((r.path, r.parent_path, tuple(r.pos), r.name) for r in authors) == [("author", "", (0,), "n"), ("review.author", "", (0,), "n")]
    parts = nested.flat_table(rows, "part", ["id"]).collect()
    assert sorted((r.parent_path, tuple(r.pos), r.id) for r in parts) == [("", (0,), "1"), ("part", (0, 0), "2"), ("part.part", (0, 0, 0), "3")]
    assert {c.full for r in rows.collect() if r.path == "" for c in r.cells} == {"a~1b"}


def test_planned_tables_of_crawls(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/crawl_results.parquet").select("crawl_id", "payload")
    plan, rows = nested.crawl_tables(table)
    parent = plan.parent(nested.LINKS)
    assert {"results", nested.LINKS} <= plan.repeated and parent in ("results", "results[].links") and plan.level(nested.LINKS) == (1 if parent == "results" else 2)
    links = nested.flat_table(rows, nested.LINKS, ["href"]).filter("href IS NOT NULL")
    results = nested.flat_table(rows, parent, []).select("crawl_id", F.col("path").alias("parent_path"), F.col("pos").alias("p"))
    joined = links.join(results, ["crawl_id", "parent_path"]).filter(F.slice("pos", 1, F.size("pos") - 1) == F.col("p"))
    assert joined.count() == links.count() > 0


def test_bodies(spark):
    df = spark.createDataFrame([(1, json.dumps({"results": [{"markdown": {"fit_markdown": "f"}}, {"markdown": "m"}, {"markdown": {"fit_markdown": None}}, 3]}))], "crawl_id long, payload string")
    assert sorted(map(tuple, nested.crawl_bodies(df).collect())) == [(1, 0, "f"), (1, 1, "m")]
