"""Whole-table queries that SQL cannot express against plain Python."""

import re

from conftest import DATA

from cairn.operators import chunking, nested, robots
from cairn.plans import job_queries, page_queries, registry

assert job_queries and page_queries


def rows(spark, name):
    return registry.QUERIES[name](spark, DATA).collect()


def table(spark, name, *columns):
    return spark.read.parquet(f"{DATA}/{name}.parquet").select(*columns).collect()


def test_crawl_frontier(spark):
    r = spark.read.parquet(f"{DATA}/crawl_results.parquet")
    links = nested.crawl_fields(r).filter("path = 'links.internal.href'").join(r.select("crawl_id", "requested_url", "host"), "crawl_id")
    keyed = links.select(robots.dedup_key("requested_url").alias("s"), robots.dedup_key(robots.resolve(links["requested_url"], links["val"])).alias("t")).collect()
    follow = {}
    for e in keyed:
        if e.s != e.t:
            follow.setdefault(e.s, set()).add(e.t)
    seeds = {}
    for x in r.select("host", "requested_url", robots.dedup_key("requested_url").alias("k")).collect():
        if x.host not in seeds or x.requested_url < seeds[x.host][0]:
            seeds[x.host] = (x.requested_url, x.k)
    expected = {k: (0, None) for _, k in seeds.values()}
    level = list(expected)
    for depth in (1, 2, 3):
        parents = {}
        for s in level:
            for t in follow.get(s, ()):
                if t not in expected and (t not in parents or s < parents[t]):
                    parents[t] = s
        expected |= {t: (depth, s) for t, s in parents.items()}
        level = list(parents)
    assert {x.key: (x.depth, x.parent) for x in rows(spark, "crawl_frontier")} == expected


def test_section_asof(spark):
    first = {}
    for p in table(spark, "page_cache", "document_id", "record_id", "markdown"):
        if p.document_id is not None and (p.document_id not in first or p.record_id < first[p.document_id][0]):
            first[p.document_id] = (p.record_id, p.markdown or "")
    expected = {}
    for p in table(spark, "passages", "passage_id", "document_id", "start_index"):
        best, at, fenced = None, 0, False
        for line in first.get(p.document_id, (0, ""))[1].split("\n"):
            if re.match(r"\s*(```|~~~)", line):
                fenced = not fenced
            elif not fenced and (m := re.fullmatch(r"\s*#{1,6} (.*)", line, re.S)) and p.start_index is not None and at <= p.start_index:
                best = m[1].strip()
            at += len(line) + 1
        expected[p.passage_id] = best
    assert {x.passage_id: x.nearest_heading for x in rows(spark, "section_asof")} == expected


def test_page_tables(spark):
    found = {}
    for x in rows(spark, "page_tables"):
        found.setdefault(x.record_id, []).append((x.table_no, x.row_no, x.column_no, x.text))
    expected = {}
    for p in table(spark, "page_cache", "record_id", "raw_html"):
        body = re.sub(r"<!--.*?-->", "", p.raw_html or "", flags=re.S)
        cells = []
        for k, block in enumerate(re.findall(r"(?:<tr>.*?</tr>\s*)+", body, re.S)):
            for i, row in enumerate(re.findall(r"<tr>(.*?)</tr>", block, re.S)):
                cells += [(k, i, j, " ".join(re.sub("<[^>]*>", "", c).split())) for j, c in enumerate(re.findall(r"<t[dh][^>]*>(.*?)</t[dh]>", row, re.S))]
        if cells:
            expected[p.record_id] = cells
    import html

    assert {k: [(*c[:3], html.unescape(c[3])) for c in v] for k, v in expected.items()} == {k: sorted(v) for k, v in found.items()}


def test_chunks_cover_texts(spark):
    texts = {r.request_id: (r.text, r.params) for r in table(spark, "chunk_requests", "request_id", "text", "params")}
    for name in ("semantic_chunks", "greedy_chunks"):
        by_request = {}
        for x in rows(spark, name):
            by_request.setdefault(x.request_id, []).append(x)
        assert set(by_request) == {k for k, (t, _) in texts.items() if t and t.strip()}
        for k, chunks in by_request.items():
            text, params = texts[k]
            top, _, segment = chunking.resolve_strategy(None, *((params.max_chunk_tokens, params.min_chunk_tokens, params.initial_segment_tokens) if params else (None, None, None)))
            chunks.sort(key=lambda x: x.chunk_no)
            assert all(a.end_index <= b.start_index and not text[a.end_index : b.start_index].strip() for a, b in zip(chunks, chunks[1:], strict=False))
            assert not text[: chunks[0].start_index].strip() and not text[chunks[-1].end_index :].strip()
            assert all(x.token_count <= top or x.token_count <= segment for x in chunks)
