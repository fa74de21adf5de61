"""Main content of pages: the lines of Markdown and HTML bodies that carry the article.

HTML is read as a stream of standard-library parser events; Markdown lines are scanned for their own markup. Every line
gets a text-to-tag ratio: its characters of sentence text (or of a heading, row, quote, code or list of outside links)
times the probability that its wording is an article's, over its tags. The log-odds of the wording are smoothed with a
Gaussian over neighbouring lines, and the border between the two clusters of the logarithms of all ratios decides which
lines are content.

The wording is learnt, without lists of phrases: pages that mark their furniture (``nav``, ``aside``, ``footer``, ``form``
and the like, or a class named after such a part) and their article (``article``, ``main``) train a naive Bayes model of
words, word pairs and line shapes; lines of other regions join by expectation-maximization. The model and the border
come from the lines of all pages with HTML. These are parsed and encoded once; each round adds up counts of fixed size in
shuffles, and the border is that of the counts of all ratios, taken to 1/``STEPS``. Chances count in 1/``GRAIN``, so sums
are exact and the model does not depend on how the pages are spread over tasks.

Defined results: null and blank bodies have no lines; line numbers count from 1 at every \\n; blank and purely structural
lines never count; script, style, template and head text never counts; very long single lines are one line; malformed
HTML is read as far as the parser can; copies of a page each give their own rows; without any page that marks both kinds
of regions wording counts alike and the ratios alone decide.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.neardup import FAN, folded
from cairn.session import checkpoint

SIGMA, MIN_WORDS, TAG_WEIGHT, BASE = 0.5, 4, 0.2, 40.0
BUCKETS, PART, ROUNDS, CAP, CLIP = 1 << 18, 1 << 16, 5, 4.0, 4.0
GRAIN, STEPS = 1 << 16, 1 << 14
CHUNK = 256  # pages encoded at a time; bounds the arrays, whatever the bodies' length
SKIPPED = frozenset("script style noscript template head title svg iframe".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = frozenset("div article section main header ul ol table".split())
FURNITURE_TAGS = frozenset("nav aside footer form button select menu dialog".split())
#: Usual class names of such parts of a page.
FURNITURE_CLASS = re.compile(r"(?:nav|navbar|menu|crumb|breadcrumb|cookie|consent|foot|footer|share|social|promo|related|sidebar|banner|comment|ad)s?")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

SENTENCES = re.compile(r"(?<=[.!?…])[\"'”’»)]*\s+")
ENDS = re.compile(r"[.!?…。！？:;][\"'”’»)\]*_`]*$")
MD_LINK = re.compile(r"!?\[([^\]\[]*)\]\(([^()\s]*)[^()]*\)")
LEAD = re.compile(r"^\s*(?:>\s?)*\s*(?:[-*+•]\s+|\d{1,3}[.)]\s+)?")
FENCE = re.compile(r"^\s*(?:```|~~~)")
RULE = re.compile(r"^[\s|:+*_=~>#-]*$")
WORDS = re.compile(r"[^\W\d_]+")
TOKENS = re.compile(r"\d[\d.,]*|[^\W\d_]+(?:['’-][^\W\d_]+)*|[©›·…]")


def sentence_text(text: str) -> int:
    """Characters of a line that read as sentences; 0 for menus and labels."""
    good = 0
    for s in SENTENCES.split(text.strip()):
        n = len(WORDS.findall(s))
        if n >= MIN_WORDS and (ENDS.search(s) or n >= 14) or n and n < MIN_WORDS and ENDS.search(s) and len(text) > 2 * len(s):
            good += len(s)
    return good


FURNITURE, ARTICLE, UNMARKED = 0, 1, -1  # regions


class Line:
    """What one line of a body holds: visible text, its amount inside links, tags, and its kind."""

    __slots__ = ("no", "text", "kind", "tags", "linked", "outside", "inside", "block", "region")

    def __init__(self, no: int, text: str, kind: str, tags: int, linked: int, outside: int, inside: int, block: int, region: int = -1):
        self.no, self.text, self.kind, self.tags, self.linked, self.outside, self.inside, self.block, self.region = no, text, kind, tags, linked, outside, inside, block, region


def markdown_lines(body: str) -> list[Line]:
    out, block, fenced = [], 0, False
    for no, raw in enumerate(body.split("\n"), 1):
        line = raw.strip()
        if FENCE.match(raw):
            fenced = not fenced
            continue
        if fenced:
            if line:
                out.append(Line(no, line, "code", 0, 0, 0, 0, block))
            continue
        if not line:
            block += 1
            continue
        if RULE.match(line):
            continue
        links = MD_LINK.findall(line)
        text = MD_LINK.sub(r"\1", line) if links else line
        linked = sum(len(a) for a, _ in links)
        outside = sum(1 for _, u in links if u.startswith(("http://", "https://", "//")))
        head = line.lstrip("> ")
        if head.startswith("#"):
            kind = "heading"
        elif line.startswith("|") and line.count("|") > 1:
            kind = "row"
        elif line.startswith(">"):
            kind = "quote"
        elif re.match(r"[-*+•]\s", line) or re.match(r"\d{1,3}[.)]\s", line):
            kind = "item"
        else:
            kind = "plain"
        text = (text.lstrip("#> ") if kind == "heading" else LEAD.sub("", text)).strip()
        out.append(Line(no, text, kind, len(links), linked, outside, len(links) - outside, block))
    return out


class _Events(HTMLParser):
    """Collects, per source line, visible text, tags, the kind of the innermost block element and the marked region."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: dict[int, list] = {}  # line -> [texts, tags, linked, outside, inside, kinds, block, region]
        self.skip = self.furniture = self.article = 0
        self.open: list[tuple[str, bool]] = []
        self.link: str | None = None
        self.block = 0

    def _row(self, no: int) -> list:
        row = self.rows.get(no)
        if row is None:
            row = self.rows[no] = [[], 0, 0, 0, 0, set(), self.block, UNMARKED]
        return row

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._row(self.getpos()[0])[1] += 1
        if tag in VOID:
            return
        named = dict(attrs)
        furniture = tag in FURNITURE_TAGS or any(FURNITURE_CLASS.fullmatch(c) for c in (named.get("class") or "").lower().split())
        self.open.append((tag, furniture))
        self.skip += tag in SKIPPED
        self.furniture += furniture
        self.article += tag in ("article", "main")
        if furniture or tag in BLOCKS:
            self.block += 1
        elif tag == "a":
            self.link = named.get("href") or ""

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self._row(self.getpos()[0])[1] += 1

    def handle_endtag(self, tag: str) -> None:
        self._row(self.getpos()[0])[1] += 1
        if not any(t == tag for t, _ in self.open):
            return
        while self.open:
            last, furniture = self.open.pop()
            self.skip -= last in SKIPPED
            self.furniture -= furniture
            self.article -= last in ("article", "main")
            if furniture or last in BLOCKS:
                self.block += 1
            elif last == "a":
                self.link = None
            if last == tag:
                break

    def handle_data(self, data: str) -> None:
        if self.skip:
            return
        no = self.getpos()[0]
        for k, text in enumerate(data.split("\n")):
            if not text.strip():
                continue
            row = self._row(no + k)
            row[0].append(text)
            if self.link is not None:
                row[2] += len(text)
                if self.link.startswith(("http://", "https://", "//")):
                    row[3] += 1
                else:
                    row[4] += 1
            row[5].update(t for t, _ in self.open)
            row[7] = FURNITURE if self.furniture else ARTICLE if self.article else UNMARKED


def html_lines(body: str) -> list[Line]:
    events = _Events()
    try:
        events.feed(body)
        events.close()
    except (AssertionError, ValueError):  # the standard parser gives up on some malformed declarations
        pass
    out = []
    for no in sorted(events.rows):
        texts, tags, linked, outside, inside, kinds, block, region = events.rows[no]
        text = " ".join("".join(texts).split())
        if not text:
            continue
        kind = "heading" if kinds & HEADINGS else "row" if kinds & {"td", "th"} else "quote" if "blockquote" in kinds else "item" if "li" in kinds else "code" if "pre" in kinds else "plain"
        if kind == "item":
            text = LEAD.sub("", text)
        out.append(Line(no, text, kind, tags, linked, outside, inside, block, region))
    return out


def text_amount(line: Line) -> float:
    """Characters of a line that may be an article's, by its form alone."""
    size = len(line.text)
    if line.kind in ("code", "heading"):
        return BASE + size
    if line.kind == "row":
        return 0.0 if line.inside and line.linked > 0.8 * size else BASE + size
    if line.linked > 0.6 * size:
        return BASE + size if line.outside and not line.inside and line.kind == "item" else 0.0
    good = sentence_text(line.text)
    return BASE + size if line.kind == "quote" and not good else float(good)


def amounts_of(lines: list[Line]) -> np.ndarray:
    """Text over tags of each line."""
    return np.array([text_amount(x) / (1 + TAG_WEIGHT * x.tags) for x in lines])


class Encoder:
    """Hashed features of lines: words, word pairs with names masked, and the shape of the line; numbers are masked in both.

    A capitalised word counts as itself among the words: it may be a name, which hardly recurs, or a German noun or pronoun.
    """

    SHAPES = 5

    def __init__(self, limit: int = 300_000):
        self.first: dict[str, tuple[int, int]] = {}  # word -> (itself, its form in pairs)
        self.later: dict[str, tuple[int, int]] = {}
        self.shapes: dict[str, list[int]] = {}
        self.limit = limit

    @staticmethod
    def _id(feature: str) -> int:
        return xxhash.xxh32_intdigest(feature) & (BUCKETS - 1)

    def _word(self, w: str, at_start: bool) -> tuple[int, int]:
        own = self._id("#n" if w[0].isdigit() else w.lower())
        return own, self._id("#name") if not at_start and w[0].isupper() and not w.isupper() else own

    def __call__(self, lines: list[Line]) -> tuple[np.ndarray, np.ndarray]:
        """(features, number of the line each belongs to)."""
        first, later, own, words, shapes, counts = self.first, self.later, [], [], [], []
        if len(first) + len(later) > self.limit:
            first.clear()
            later.clear()
            self.shapes.clear()
        start, end = self._id("^"), self._id("$")
        for line in lines:
            words.append(start)
            known, n = first, 0
            for w in TOKENS.findall(line.text):
                h = known.get(w)
                if h is None:
                    h = known[w] = self._word(w, known is first)
                own.append(h[0])
                words.append(h[1])
                known = later
                n += 1
            words.append(end)
            counts.append(n + 2)
            size, last = len(line.text), line.text[-1:]
            link = ("0" if not line.linked else "L" if line.linked > 0.6 * size else "l") + ("i" if line.inside else "") + ("o" if line.outside else "")
            key = f"\0{line.kind} {link} {'w' if last.isalnum() else last} {min(n // 3, 5)}"
            found = self.shapes.get(key)
            if found is None:
                kind, link, last, size = key[1:].split(" ")
                found = self.shapes[key] = [self._id(f) for f in (f"\0k{kind}", f"\0l{link}", f"\0e{last}", f"\0n{size}", f"\0{kind}{link}")]
            shapes.extend(found)
        row = np.repeat(np.arange(len(lines)), counts)
        w = np.array(words, dtype=np.uint64)
        pairs = ((w[:-1] * np.uint64(0x9E3779B97F4A7C15) + w[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)) & np.uint64(BUCKETS - 1)
        edge = np.zeros(len(w), dtype=bool)
        ends = np.cumsum(counts)
        edge[ends - 1] = edge[ends - counts] = True
        inner = row[:-1] == row[1:]
        return np.concatenate([np.array(own, dtype=np.uint64), pairs[inner], np.array(shapes, dtype=np.uint64)]).astype(np.int64), np.concatenate([row[~edge], row[:-1][inner], np.repeat(np.arange(len(lines)), self.SHAPES)])


class LineModel:
    """Weight of each feature for article against furniture, prior log-odds, and the border of the two clusters."""

    def __init__(self, weights: np.ndarray, prior: float, border: float):
        self.weights, self.prior, self.border = weights, prior, border

    def log_odds(self, flat: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """Log-odds of each line to be an article's by its wording."""
        return np.bincount(row, self.weights[flat], n) + self.prior

    def ratios(self, amounts: np.ndarray, odds: np.ndarray, counts: list[int]) -> np.ndarray:
        """Logarithms of the text-to-tag ratios of bodies with so many lines each; wording is smoothed within a body."""
        ends = np.cumsum(counts)
        level = np.concatenate([smooth(x) for x in np.split(np.clip(odds, -CLIP, CLIP), ends[:-1])]) if counts else odds
        return np.log1p(amounts / (1 + np.exp(-level)))


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = max(1, round(3 * sigma))
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma))
    pad = np.zeros(reach)
    total = np.convolve(np.concatenate([pad, values, pad]), kernel, mode="valid")
    return total / np.convolve(np.concatenate([pad, np.ones(len(values)), pad]), kernel, mode="valid")


def cluster_border(values: np.ndarray, counts: np.ndarray) -> float:
    """Border between the two clusters of values that occur so often (two means)."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        mid = (low + high) / 2
        above = values > mid
        if high - low < 1e-9 or above.all() or not above.any():
            break
        now = float(np.average(values[~above], weights=counts[~above])), float(np.average(values[above], weights=counts[above]))
        if now == (low, high):
            break
        low, high = now
    return (low + high) / 2


def encode_pages(pages: DataFrame, key_cols: list[str], html_col: str) -> DataFrame:
    """The lines of all pages as numbers, written once: ``keys`` of up to ``CHUNK`` pages and a blob of their arrays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = Encoder()
        for whole in batches:
            for at in range(0, len(whole), CHUNK):
                batch = whole.iloc[at : at + CHUNK]
                pages = [html_lines(body) for body in batch["_html"]]
                lines = [x for page in pages for x in page]
                if not lines:
                    continue
                flat, row = encode(lines)
                arrays = flat.astype(np.int32), row.astype(np.int32), np.array([x.region for x in lines], dtype=np.int8), amounts_of(lines), np.array([x.no for x in lines], dtype=np.int32), np.array([len(x) for x in pages], dtype=np.int32)
                yield pd.DataFrame({"keys": [batch[key_cols].to_dict("records")], "lines": [zlib.compress(pickle.dumps(arrays), 1)]})

    schema = T.StructType([T.StructField("keys", T.ArrayType(T.StructType([pages.schema[c] for c in key_cols]))), T.StructField("lines", T.BinaryType())])
    return checkpoint(pages.filter(F.length(F.trim(html_col)) > 0).select(*key_cols, F.col(html_col).alias("_html")).mapInPandas(run, schema))


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    for batch in batches:
        for blob in batch.column(0):
            flat, row, *others = pickle.loads(zlib.decompress(blob.as_py()))
            yield flat.astype(np.int64), row.astype(np.int64), *others


def line_chances(odds: np.ndarray, regions: np.ndarray) -> np.ndarray:
    """Probability of each line to be an article's, in whole parts of ``GRAIN``; marked lines are certain."""
    chance = np.round(GRAIN / (1 + np.exp(-np.clip(odds, -30, 30)))) / GRAIN
    chance[regions == ARTICLE], chance[regions == FURNITURE] = 1.0, 0.0
    return chance


def _sum_counts(encoded: DataFrame, model: LineModel, first: bool) -> tuple[np.ndarray, np.ndarray, float, float, float, float]:
    """One round over all lines: feature counts of articles and of furniture; weight of articles, known, article and furniture lines."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, pos, neg, totals = shared.value, np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(4)
        for flat, row, regions, *_ in _arrays(batches):
            chance = line_chances(own.log_odds(flat, row, len(regions)), regions)
            known = (regions != UNMARKED) | (not first)  # the first round knows the marked lines only
            used, weight = known[row], chance[row]
            pos += np.bincount(flat[used], weight[used], BUCKETS)
            neg += np.bincount(flat[used], 1 - weight[used], BUCKETS)
            totals += chance[known].sum(), known.sum(), (regions == ARTICLE).sum(), (regions == FURNITURE).sum()
        for part in range(BUCKETS // PART):
            cut = slice(part * PART, (part + 1) * PART)
            sums = zlib.compress(np.concatenate([pos[cut], neg[cut], totals if part == 0 else np.zeros(4)]).tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([TaskContext.get().partitionId() % FAN], pa.int32()), pa.array([sums], pa.binary())], names=["part", "slot", "counts"])

    parts, size = encoded.select("lines").mapInArrow(scan, "part int, slot int, counts binary"), 2 * PART + 4
    pos, neg, totals = np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(4)
    for r in folded(folded(parts, ["part", "slot"], np.float64, size, np.add), ["part"], np.float64, size, np.add).collect():  # BUCKETS / PART rows
        sums = np.frombuffer(zlib.decompress(r.counts), dtype=np.float64)
        pos[r.part * PART : (r.part + 1) * PART], neg[r.part * PART : (r.part + 1) * PART] = sums[:PART], sums[PART : 2 * PART]
        totals += sums[2 * PART :]
    return pos, neg, *totals.tolist()


def _count_ratios(encoded: DataFrame, model: LineModel) -> tuple[np.ndarray, np.ndarray]:
    """The ratios of all lines to 1/``STEPS``, and how often each occurs. Their range bounds what the driver gets."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = shared.value, np.zeros(0, dtype=np.int64)
        for flat, row, regions, amounts, _, counts in _arrays(batches):
            ratios = own.ratios(amounts, own.log_odds(flat, row, len(regions)), counts[counts > 0].tolist())
            more = np.bincount(np.round(ratios * STEPS).astype(np.int64), minlength=len(seen))
            more[: len(seen)] += seen
            seen = more
        values = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(values, pa.int64()), pa.array(seen[values], pa.int64())], names=["value", "n"])

    found = encoded.select("lines").mapInArrow(scan, "value long, n long").groupBy("value").agg(F.sum("n").alias("n")).toPandas().sort_values("value")
    return found["value"].to_numpy() / STEPS, found["n"].to_numpy()


def fit(encoded: DataFrame, rounds: int = ROUNDS) -> LineModel:
    """Naive Bayes by expectation-maximization from the marked and unmarked lines of all pages of ``encode_pages``."""
    model = LineModel(np.zeros(BUCKETS, dtype=np.float32), 0.0, 0.0)
    for k in range(rounds):
        pos, neg, weight, known, articles, furniture = _sum_counts(encoded, model, k == 0)
        if not articles or not furniture:
            break
        share = float(np.clip(weight / known, 1e-6, 1 - 1e-6))
        prior = float(np.log(share / (1 - share)))
        model = LineModel(np.clip(np.log((pos + share) / (neg + 1 - share)) - prior, -CAP, CAP).astype(np.float32), prior, 0.0)
    values, counts = _count_ratios(encoded, model)
    model.border = cluster_border(values, counts) if len(values) else float(np.log1p(BASE) / 2)
    return model


def train(pages: DataFrame, id_col: str, html_col: str) -> LineModel:
    """The model of all pages."""
    return fit(encode_pages(pages, [id_col], html_col))


def encoded_lines(encoded: DataFrame, model: LineModel) -> DataFrame:
    """Key columns and ``line_no`` of every article line of the pages of ``encode_pages``."""
    shared, keys = encoded.sparkSession.sparkContext.broadcast(model), encoded.schema["keys"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for own_keys, (flat, row, regions, amounts, numbers, counts) in zip(batch.column(1), _arrays([batch]), strict=True):
                keep = own.ratios(amounts, own.log_odds(flat, row, len(regions)), counts[counts > 0].tolist()) > own.border
                of_line = own_keys.values.take(pa.array(np.repeat(np.arange(len(counts)), counts)[keep]))
                yield pa.RecordBatch.from_arrays([*of_line.flatten(), pa.array(numbers[keep])], names=[*keys.names, "line_no"])

    return encoded.select("lines", "keys").mapInArrow(run, T.StructType([*keys.fields, T.StructField("line_no", T.IntegerType())]))


def batch_lines(bodies: list[str | None], html: bool, model: LineModel, encode: Encoder) -> list[list[int]]:
    """Numbers of the lines of each body that belong to the article; all lines are encoded at once."""
    pages = [(html_lines(x) if html else markdown_lines(x)) if x is not None and x.strip() else [] for x in bodies]
    lines = [x for page in pages for x in page]
    if not lines:
        return [[] for _ in bodies]
    keep = model.ratios(amounts_of(lines), model.log_odds(*encode(lines), len(lines)), [len(x) for x in pages if x]) > model.border
    out, at = [], 0
    for page in pages:
        out.append([x.no for x, ok in zip(page, keep[at : at + len(page)].tolist(), strict=True) if ok])
        at += len(page)
    return out


def article_lines(body: str | None, html: bool, model: LineModel) -> list[int]:
    return batch_lines([body], html, model, Encoder())[0]


def extract_lines(df: DataFrame, key_cols: list[str], body_col: str, html: bool, model: LineModel, skip: Callable[[], Callable[[str], bool]] | None = None) -> DataFrame:
    """Key columns and ``line_no`` of every article line. One pass where the bodies are read, no shuffle.

    ``skip`` makes, in each task, a test for bodies that have no article at all.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, encode = shared.value, Encoder()
        without = skip() if skip is not None else None
        for whole in batches:
            for at in range(0, len(whole), CHUNK):
                batch = whole.iloc[at : at + CHUNK]
                bodies = [None if x is None or without is not None and without(x) else x for x in batch["_body"]]
                found = batch_lines(bodies, html, own, encode)
                out = batch[key_cols].loc[batch.index.repeat([len(x) for x in found])].reset_index(drop=True)
                out["line_no"] = pd.Series([n for x in found for n in x], dtype="int32")
                yield out

    schema = T.StructType([*[df.schema[c] for c in key_cols], T.StructField("line_no", T.IntegerType())])
    return df.select(*key_cols, F.col(body_col).alias("_body")).mapInPandas(run, schema)
