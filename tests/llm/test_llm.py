"""The operators for training data against brute force, round trips and the edge cases their docstrings define."""

import datetime as dt
import random

import pytest
from conftest import DATA, compare
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.llm import bpe, leakage, maincontent, neardup, queries, residue, splitting, survivorship, toxicity
from cairn.text import plain_words, words


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    compare(spark, name, queries.QUERIES, queries.SQL)


# -- near duplicates ---------------------------------------------------------------------------------------------------


def brute_pairs(rows, n, threshold):
    sets = {}
    for k, t in rows:
        w = words(t)
        s = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        if s:
            sets[k] = s
    ids = sorted(sets)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def corpus(rng, n=120):
    vocabulary = [f"w{k}" for k in range(60)]
    rows = [(1, None), (2, ""), (3, "two words"), (4, "x y z"), (5, "X, y z!")]
    for k in range(10, 10 + n):
        if k % 3 and len(rows) > 8:
            t = rng.choice(rows[5:])[1].split()
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            rows.append((k, " ".join(t)))
        else:
            rows.append((k, " ".join(rng.choices(vocabulary, k=rng.randint(5, 60)))))
    return rows


@pytest.mark.parametrize(("n", "threshold", "split"), [(3, 0.5, 512), (5, 0.8, 512), (3, 0.5, 2)])
def test_neardup(spark, n, threshold, split):
    rows = corpus(random.Random(n * 7 + split))
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "id long, text string, digest string").repartition(3)
    if split == 512:
        got = {tuple(r) for r in neardup.near_duplicate_pairs(df, "id", "text", n, threshold).collect()}
        assert got == brute_pairs(rows, n, threshold)
    else:
        links, members = neardup.similar_classes(df, "id", "text", n, threshold, split=split, buckets=1 << 10)
        rep = {r.id: r.rep for r in members.collect()}
        assert {tuple(sorted((r.a, r.b))) for r in links.collect()} == {tuple(sorted((rep[a], rep[b]))) for a, b in brute_pairs(rows, n, threshold) if rep[a] != rep[b]}


def test_neardup_copies_and_empty(spark):
    rows = [(k, "a b c d e f") for k in range(9)] + [(20, "a b c d e g")]
    df = spark.createDataFrame(rows, "id long, text string")
    assert len(neardup.near_duplicate_pairs(df, "id", "text", 3, 0.5).collect()) == 45
    groups = {r.id: (r.group_id, r.class_id, r.copies, r.n_links) for r in neardup.near_duplicate_groups(df, "id", "text", 3, 0.5).collect()}
    assert groups == {k: (0, 0, 9, 1) for k in range(9)} | {20: (0, 20, 1, 1)}
    assert neardup.near_duplicate_pairs(df.filter("false"), "id", "text", 3, 0.5).count() == 0


def test_neardup_large_classes_in_full(spark):
    text = "one two three four five six seven eight nine ten"
    spellings = [text, text.upper(), text.replace(" ", ", ") + "."]
    rows = [(k, spellings[k % 3]) for k in range(100)] + [(1000 + k, text + " eleven") for k in range(60)] + [(2000, "zero " + text), (3000, "quite another text")]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    expected = sorted(brute_pairs(rows, 3, 0.5))
    assert len(expected) == 161 * 160 // 2
    for block in (neardup.BLOCK, 7):
        assert sorted(map(tuple, neardup.near_duplicate_pairs(df, "id", "text", 3, 0.5, block=block).collect())) == expected


def test_neardup_full_sketch(spark):
    """A sketch far too small for the texts gives the same links, and no row more than the prefixes have n-grams."""
    df = spark.read.parquet("/root/testdata/sf0.001/passages.parquet").select(F.col("passage_id").alias("id"), "text").filter("text IS NOT NULL")
    found, rows = [], []
    for buckets in (1 << 18, 1 << 4):
        links, _ = neardup.similar_classes(df, "id", "text", 3, 0.5, split=16, buckets=buckets)
        found.append({(r.a, r.b) for r in links.collect()})
        order = neardup._order(neardup._signatures(df, 3, buckets), buckets)
        rows.append(neardup._prefixes(df, 3, 0.5, neardup.LEAST, order).count())
    assert found[0] == found[1] and found[0]
    sizes = [len(neardup.ngrams(r.text, 3, neardup.WordIds())) for r in df.select("text").collect()]
    assert rows[0] <= rows[1] <= sum(neardup.prefix_length(k, 0.5) + neardup.LEAST - 1 for k in sizes if k)  # a row per prefix n-gram at most


def test_components(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r.id: r.group for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: root(k) for k in parent}


# -- survivorship ------------------------------------------------------------------------------------------------------


def test_survivors(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [
        ("d", "f", "n/a", "a", "high", t), ("d", "f", " good  value ", "b", " HIGH", t), ("d", "f", "good value", "a", "low", None), ("d", "f", "good value is long…", "z", None, None),
        ("d", "f", "good value is long enough [...]", "z", None, None), ("d", "g", "b", "a", "high", t), ("d", "g", "a", "a", "high", t), (None, "f", "x", "a", None, None), ("e", "f", None, "a", "high", t), ("e", "f", "--", "a", "high", t),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "k string, f string, value string, source string, confidence string, observed_at timestamp, source_rank string")
    ranks = spark.createDataFrame([("f", "a", 0), ("f", "b", 1), ("g", "a", 0)], "f string, source string, source_rank int")
    got = {(r.k, r.f): r.value for r in survivorship.survivors(df, ["k", "f"], ranks, ["f", "source"]).collect()}
    assert got == {("d", "f"): "good value is long enough [...]", ("d", "g"): "a", (None, "f"): "x"}
    assert survivorship.survivors(df.filter("false"), ["k", "f"]).count() == 0


# -- main content ------------------------------------------------------------------------------------------------------

BODY = "[Home](/home) | [Help](/help)\n\n# A title\n\nThe council opened a new bridge near the harbour last week.\n\nWe use cookies to keep this site running and to count visits.\nAccept all Reject\n\n- The first item of the list says something.\n- [Outside](https://o.test/x)\n\n| a | b |\n|---|---|\n| c | d |\n\nThe regulator asked 9 sites how long a cookie stays on the device.\n\nShare this page\nPrint\n\nRelated stories\n1. Another title here\n\n© 2024 Some Media. All rights reserved."


@pytest.fixture(scope="module")
def line_model(spark):
    return maincontent.train(spark.read.parquet("/root/testdata/sf0.01/page_cache.parquet"), "record_id", "raw_html")


def test_markdown_lines(line_model):
    assert maincontent.article_lines(BODY, False, line_model) == [3, 5, 10, 11, 13, 15, 17]
    assert maincontent.article_lines(None, False, line_model) == maincontent.article_lines(" \n ", True, line_model) == []
    assert maincontent.article_lines("The one line of a very long text goes on. " * 3000, False, line_model) == [1]


def test_html_lines(spark, line_model):
    page = "<html><head><title>Some title of the page here.</title>\n<script>var x = 'A sentence that is long enough.';</script></head>\n<body><nav>\n<a href='/x'>Home</a></nav>\n<h1>The harbour notes</h1>\n<p>The council opened a new bridge near the harbour.</p>\n<p>Back to top</p>\n<p>Broken <b>markup still counts as a sentence of text.\n</body>"
    assert maincontent.article_lines(page, True, line_model) == [5, 6, 8]
    df = spark.createDataFrame([(1, page, "z"), (1, page, "z"), (2, None, "z")], "id long, body string, line_no string")
    assert sorted(map(tuple, maincontent.extract_lines(df, ["id"], "body", True, line_model).collect())) == [(1, k) for k in (5, 5, 6, 6, 8, 8)]
    skipped = maincontent.extract_lines(df, ["id"], "body", True, line_model, lambda: lambda text: True)
    assert skipped.count() == 0


def test_clusters_and_wording_decide(spark, line_model):
    """Without the border nearly all lines with any text come in; a model that knows no marked page decides by ratios alone."""
    bodies = [r.markdown for r in spark.read.parquet("/root/testdata/sf0.01/page_cache.parquet").select("markdown").collect() if r.markdown]
    lines = lambda m: {(k, n) for k, b in enumerate(bodies) for n in maincontent.article_lines(b, False, m)}
    own = lines(line_model)
    open_border = lines(maincontent.LineModel(line_model.weights, line_model.prior, 0.0))
    assert own < open_border and len(open_border) > 1.05 * len(own)
    blind = maincontent.train(spark.createDataFrame([(1, "<p>One unmarked page is all there is.</p>")], "id long, h string"), "id", "h")
    assert not blind.weights.any() and maincontent.article_lines("A sentence of several words.", False, blind) == [1]
    assert maincontent.train(spark.createDataFrame([], "id long, h string"), "id", "h").border > 0


def test_model_of_all_pages(spark):
    """Wording of any page is learnt, and the border is that of all lines, however many pages there are."""
    order = [r.id for r in spark.range(6000).orderBy(F.xxhash64("id"), "id").collect()]
    late = set(order[5500:])
    page = "<article><p>The {} opened near the harbour last week.</p></article>\n<nav><a href='/x'>The {} of this site</a></nav>"
    df = spark.createDataFrame([(k, page.format("quagga", "okapi") if k in late else page.format("bridge", "menu")) for k in range(6000)], "id long, h string")
    model = maincontent.train(df, "id", "h")
    weight = lambda w: model.weights[maincontent.Encoder._id(w)]
    assert weight("quagga") > 1 and weight("okapi") < -1 and weight("bridge") > 1 and weight("menu") < -1


def test_capitalised_words_tell_apart():
    """Capitalised words count as themselves, so notices in German differ from reports; pairs mask them as names."""
    encode = maincontent.Encoder()
    one, two = (set(encode([maincontent.Line(1, f"Wir nutzen {w} auf der Seite.", "plain", 0, 0, 0, 0, 0)])[0].tolist()) for w in ("Cookies", "Karten"))
    assert one ^ two == {encode._id("cookies"), encode._id("karten")}


def test_model_and_lines_of_encoded_pages(spark):
    """The model does not depend on how pages are spread over tasks; encoded pages give the lines that their bodies give."""
    pages = spark.read.parquet("/root/testdata/sf0.001/page_cache.parquet").select("record_id", "raw_html")
    models = []
    for n in (1, 5):
        encoded = maincontent.encode_pages(pages.repartition(n), ["record_id"], "raw_html")
        models.append(maincontent.fit(encoded))
        own = sorted(map(tuple, maincontent.encoded_lines(encoded, models[-1]).collect()))
        assert own and own == sorted(map(tuple, maincontent.extract_lines(pages, ["record_id"], "raw_html", True, models[-1]).collect()))
    assert (models[0].weights == models[1].weights).all() and models[0].border == models[1].border and models[0].prior == models[1].prior


# -- residue -----------------------------------------------------------------------------------------------------------


def test_residue(spark):
    sound = ["The council opened a bridge.", "A late report lists many harbours.", "In May the library closed a wing."]
    bad = ["{{ title }}", "404 Not Found", "Please enable JavaScript to view this page.", "Lorem ipsum dolor sit amet."]
    rows = [(f"{s} {sound[k % 3]}", None, True) for k in range(30) for s in sound] + [(b, "error_page", False) for b in bad for _ in range(8)] + [(s, None, None) for s in sound] + [(None, None, None), ("", None, None)]
    df = spark.createDataFrame(rows, "text string, expected_drop_rule string, agent_useful boolean")
    model = residue.train(df)
    tests = ["The council {{ name }} opened a bridge.", "`{{ name }}` prints the field in a template.", "Not Found", "A late report closed a wing.", None, " ", "Home\nSearch\nLogin"]
    cases = spark.createDataFrame([(k, t, 1.0) for k, t in enumerate(tests)], "id long, text string, score double")
    assert {r.id for r in residue.residue_cases(cases, ["id"], "text", *model).collect()} == {0, 2}
    assert residue.residue_cases(cases, ["id"], "text", *residue.train(df.filter("expected_drop_rule IS NULL"))).count() == 0


# -- splitting ---------------------------------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb.", "c,", "\n", "\n\n", "# h", " ", "d!"]), max_size=120), st.integers(1, 12), st.one_of(st.none(), st.integers(-1, 15)))
def test_pieces(parts, limit, overlap):
    text = " ".join(parts)
    tokens = [m.span() for m in splitting.TOKEN.finditer(text)]
    pieces = splitting.split_text(text, limit, overlap)
    shared = min(max(overlap or 0, 0), limit - 1)
    assert all(len(splitting.TOKEN.findall(text[a:b])) == n <= limit for a, b, n, _ in pieces)
    own = [s for a, b, n, o in pieces for s in [x for x in tokens if a <= x[0] < b][o:]]
    assert own == tokens
    seen = 0
    for k, (_, _, n, o) in enumerate(pieces):
        assert o == (min(shared, seen) if k else 0)
        seen += n - o


def test_natural_cut():
    text = "One two three four.\n\nFive six seven eight."
    assert [text[a:b] for a, b, *_ in splitting.split_text(text, 5, None)] == ["One two three four.", "Five six seven eight."]
    assert splitting.split_text(None, 5, 0) == splitting.split_text("  ", 5, 0) == [] and len(splitting.split_text("w " * 401, 0, 0)) > 1


# -- tokenizer ---------------------------------------------------------------------------------------------------------


def test_bpe_equals_library():
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    own = bpe.encoder(bpe.DEFAULT_VOCABULARY)
    library = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    rng = random.Random(3)
    texts = ["", "<|endoftext|>", "a" * 3000, " " * 500 + "x", "it's  we'll\n\n\t", "漢字かな😀é́", "ab" * 2000]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 400))) for alphabet in ("ab", "abcdefghij XYZ019", "é漢😀a \n", "'st \x1c\x85  x1") for _ in range(40)]
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own.encode(t) == e.ids
        assert bpe.decode(e.ids, own.v) == t
    assert own.encode(None) == []


def test_bpe_stream_and_decode(spark):
    own = bpe.encoder(bpe.DEFAULT_VOCABULARY)
    machine = bpe.Transducer(own.v)
    data = ("xyzzy" * 4000).encode()
    out = [t for k in range(0, len(data), 37) for t in machine.feed(data[k : k + 37])]
    assert len(machine.window) <= 4 * (own.v.lookahead + 1) + 37 and (*out, *machine.finish()) == own.piece(data.decode())
    for raw in (b"\xff", b"\xe2\x82", b"a\xe2\x28b", b"\xf0\x9f\x98\x80", b"\xed\xa0\x80"):
        m = bpe.Utf8Machine()
        assert "".join(m.feed(bytes([b])) for b in raw) + m.finish() == raw.decode("utf-8", "replace")
    df = spark.createDataFrame([(1, "ab c", "x"), (2, None, "x"), (2, "", "x")], "doc_id long, text string, ids string")
    rows = bpe.encode_documents(df)
    assert sorted((r.doc_id, len(r.ids)) for r in rows.collect()) == [(1, 2), (2, 0), (2, 0)]
    assert sorted(r.text for r in bpe.decode_documents(rows).collect()) == ["", "", "ab c"]


# -- leakage -----------------------------------------------------------------------------------------------------------


def test_leakage(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([2, 5, 14, 30])))) for k in range(25)] + [(90, None), (91, "!"), (92, "Café un")]
    docs = [(k, " ".join(rng.choices(vocabulary, k=40)) + " " + (items[k % 25][1] if k % 2 else "")) for k in range(80)] + [(200, None), (201, ""), (202, "x CAFÉ, UN y")]
    expected = set()
    for d, t in docs:
        w = plain_words(t)
        for i, u in items:
            v = plain_words(u)
            n = min(13, len(v))
            for x in {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if v else ():
                if any(tuple(w[k : k + len(x)]) == x for k in range(len(w))):
                    expected.add((d, i))
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert (202, 92) in expected
    got = [tuple(r) for r in leakage.leaked(a, b).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    assert leakage.leaked(a, b.filter("false")).count() == 0


# -- toxicity ----------------------------------------------------------------------------------------------------------


def test_disguises():
    assert toxicity.sentences("You are an i​d i o t, ѕtupid l0000ser")[0][-2:] == ["stupid", "loser"]
    assert toxicity.sentences(None) == toxicity.sentences("  ") == []
    assert toxicity.sentences("In Paris it rained.") == [["in", "<name>", "it", "rained"]]
    assert max(map(len, toxicity.sentences("word " * 5000))) <= toxicity.WINDOW


def test_classifier(spark):
    rng = random.Random(6)
    sound = ["the council opened a bridge", "a report lists the harbour", "the library closed a wing", "many readers asked for maps"]
    nasty = ["you are a stupid fool", "shut up you filthy pig"]
    rows = [(k, ". ".join(rng.choices(sound, k=5) + ([rng.choice(nasty)] if k % 3 == 0 else [])), "en", "s") for k in range(150)] + [(900, None, None, None), (901, "", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(150)], "doc_id long, toxic int")
    flagged = {r.doc_id for r in toxicity.score_documents(docs, labels).filter("flagged").collect()}
    assert flagged == {k for k in range(150) if k % 3 == 0}
    assert toxicity.score_documents(docs, labels.filter("toxic = 0")).filter("flagged").count() == 0
