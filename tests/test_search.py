"""Search end to end, and the flagship query over pages with copies, old deliveries and equal word sets."""

from cairn import engine

PAGE = "record_id long, requested_url string, final_url string, title string, markdown string, outcome string, fetched_at double"
HIT = "result_id long, query_id string, title string, url string, content string, engine string, engines array<string>, positions array<int>, score double"


def page(k, text, url=None, at=1.0, outcome="content"):
    url = url or f"https://h{k}.test/p"
    return k, url + "#top", url, f"Page {k}", text, outcome, at


def test_flagship_copies_deliveries_and_ties(spark, tmp_path):
    import __spark_entry__ as e

    body = e.SEARCH_TEXT.capitalize() + "."
    filler = " Nothing of note was said about it on that day by anybody who was there."
    rows = [page(k, body) for k in range(1, 31)]  # one text
    rows += [page(100 + k, f"{body} Item {k}." + filler * 8) for k in range(30)]  # all query words, long
    rows += [page(200, body + " " + body + " Again."), page(300, body + " Old text. " + body, "https://n.test/x", 1.0), page(301, body + " New text. " + body, "https://n.test/x", 2.0)]
    rows += [page(302, None, "https://n.test/x", 3.0, "failed"), page(400, "Other things.")]
    spark.createDataFrame(rows, PAGE).write.parquet(f"{tmp_path}/page_cache.parquet")
    best = [r.record_id for r in engine.best_pages(spark.read.parquet(f"{tmp_path}/page_cache.parquet"), e.SEARCH_TEXT, 20).collect()]
    assert len(best) == 20 and {1, 200, 301} <= set(best) and not set(best) & {*range(2, 31), 300, 302, 400}
    got = [r.record_id for r in e.search_passages(spark, str(tmp_path)).collect()]
    assert {1, 200, 301} <= set(got) <= set(best) and len(set(got)) == 20


def test_search_end_to_end(spark):
    text = "weekly harbour report"
    said = "The weekly harbour report was read aloud in the library. It names every ship."
    pages = [page(1, "Old. " + said, "https://a.test/x", 1.0), page(2, "New. " + said, "https://a.test/x", 2.0), page(3, said, "https://b.test/y"), page(4, said, "https://blocked.test/z"), page(5, said, "https://unlisted.test/u")]
    hits = [(1, "q", "Weekly report", "https://a.test/x#part", "", "e", ["e"], [1], 0.9), (2, "q", "", "https://b.test/y", "harbour", None, ["f"], [2], None), (3, "q", "Harbour", "https://blocked.test/z", "", "g", ["g"], [3], 0.8), (4, "q", "Nothing", "https://c.test/w", "", "h", ["h"], [4], 1.0)]
    found = engine.search(spark.createDataFrame(hits, HIT), spark.createDataFrame(pages, PAGE), text, "quick", blocked=spark.createDataFrame([("blocked.test",)], "host string"))
    assert {r.result_id for r in found.selected.collect()} == {1, 2, 4}  # a hit without a word of the query stays, with score 0
    passages = found.passages.collect()
    assert {r.record_id for r in passages} == {2, 3} and all("harbour" in r.text for r in passages)
    assert {r.document_id for r in passages} == {r.citation_key for r in found.citations.collect()} and {r.citation_id for r in passages} == {1, 2}
