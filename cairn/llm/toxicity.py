"""Abusive, hateful or sexual content: a convolutional sentence classifier, trained in numpy.

Sentences become hashed word embeddings; filters of several widths run over them, the maximum of each filter over the
sentence feeds a linear layer. A document's score is that of its worst sentence. Labels are per document and noisy, so
training first picks suspects by the words of whole documents, then continues on sentences: the worst one of a toxic
document against the sentences of clean documents. Models trained on folds score the documents they did not see; labels
that these scores contradict are taken for rater errors and left out, and thresholds are calibrated on them per language.
Every fit is a task of its own in an executor.

Before hashing, disguises are undone: invisible characters, look-alike letters, digits for letters, stretched, spaced and
dotted words. Names and numbers are masked; rare words share one id.

The training rows are a bounded sample of the labelled documents (``TRAIN_ROWS``); every document is scored.

Defined results: null, empty and wordless texts score 0 and are never flagged; very long texts are read whole; several
ratings of a document are averaged, ties count as clean; without both kinds of labels nothing is flagged; languages with
few labels use the common threshold; extra columns are ignored.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRAIN_ROWS = 20_000
BUCKETS, DIM, FILTERS, WIDTHS, WINDOW = 1 << 14, 24, 32, (1, 2, 3), 32
UNKNOWN, NAME, NUMBER, EDGE = 1, 2, 3, 4
STAGES, POSITIVES, EASY, FOLDS, DOUBT = 3, 1500, 5000, 3, (3.5, 1.0)
MIN_LANG = 60  # labelled documents a language needs for its own threshold

#: Cyrillic and Greek letters that look like Latin ones.
LOOKALIKE = str.maketrans("авеѕікморсухтнԁԛԝһјɡӏαοερτυνικВАЕЅІКМОРСТУХНЈΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "abesikmopcyxthdqwhjglaoeptuvikBAESIKMOPCTYXHJABEZHIKMNOPTYX")
#: Characters written for letters.
LEET = str.maketrans("013457@$€!|", "oieastaseil")
INVISIBLE = re.compile("[­​-‏⁠-⁤﻿᠎]")
SPACED = re.compile(r"(?<!\w)(?:[^\W\d_] ){3,}[^\W\d_](?!\w)")
STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
DOTTED = re.compile(r"(?<=[^\W\d_])[.*#](?=[^\W\d_]{1,3}(?!\w))")
SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’»)]*\s+|(?<=[a-zß-ÿ][.!?])(?=[A-ZÀ-Þ])|\n+| | ")
TOKEN = re.compile(r"(?=[\w@$€!|]*[^\W\d_])[^\W_](?:[\w@$€]|[!|](?=\w))*|\d[\d.,]*")


def plain(text: str) -> str:
    """Undoes disguises that do not change word borders."""
    if not text.isascii():
        text = INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    return SPACED.sub(lambda m: m.group().replace(" ", ""), text)


def word(raw: str, first: bool, shout: bool) -> str:
    """The normal form of a token; names and numbers are masked."""
    if raw[0].isdigit() and not any(c.isalpha() for c in raw):
        return "<number>"
    w = raw
    if not w.isascii() and any("a" <= c <= "z" or "A" <= c <= "Z" for c in w):
        w = w.translate(LOOKALIKE)
    if any(c in "013457@$€!|" for c in w):
        w = w.translate(LEET)
    w = STRETCHED.sub(r"\1", w)
    if w[0].isupper() and not first and not shout and not w[1:2].isupper():
        return "<name>"
    return w.lower()


class WordForms:
    """``word`` with the forms of recent tokens remembered (bounded)."""

    def __init__(self, limit: int = 200_000):
        self.kept: dict[str, str] = {}
        self.masked: dict[str, str] = {}
        self.limit = limit

    def __call__(self, tokens: list[str], shout: bool) -> list[str]:
        if len(self.kept) + len(self.masked) > self.limit:
            self.kept.clear()
            self.masked.clear()
        out, known = [], self.kept
        later = self.kept if shout else self.masked
        for t in tokens:
            w = known.get(t)
            if w is None:
                w = known[t] = word(t, known is self.kept, shout)
            out.append(w)
            known = later
        return out


def sentences(text: str | None, forms: WordForms | None = None) -> list[list[str]]:
    """Sentences of normal words; long ones in overlapping windows."""
    if not text:
        return []
    out, forms = [], forms or WordForms()
    for s in SENTENCE.split(plain(text)):
        if not s:
            continue
        tokens = TOKEN.findall(DOTTED.sub("", s) if "." in s[:-1] or "*" in s or "#" in s else s)
        if not tokens:
            continue
        words = forms(tokens, s.isupper())
        if len(words) <= WINDOW:
            out.append(words)
        else:
            out.extend(words[i : i + WINDOW] for i in range(0, len(words) - WINDOW // 4, WINDOW * 3 // 4))
    return out


def word_id(w: str) -> int:
    return 5 + xxhash.xxh32_intdigest(w) % (BUCKETS - 5)


class Lexicon:
    """Ids of words; those in fewer than ``least`` training documents share the id of unknown words."""

    def __init__(self, documents: list[list[list[str]]], least: int = 3):
        seen: Counter = Counter()
        for d in documents:
            seen.update({w for s in d for w in s})
        self.ids = {w: word_id(w) for w, n in seen.items() if n >= least} | {"<name>": NAME, "<number>": NUMBER}

    def __call__(self, words: list[str]) -> list[int]:
        get = self.ids.get
        return [get(w, UNKNOWN) for w in words]


def padded(rows: list[list[int]], length: int) -> np.ndarray:
    out = np.zeros((len(rows), length + 2), dtype=np.int32)
    out[:, 0] = EDGE
    for k, r in enumerate(rows):
        out[k, 1 : 1 + len(r)] = r
        out[k, 1 + len(r)] = EDGE
    return out


class Network:
    """Embedding, convolutions, max pooling, linear output; gradients by hand, Adam."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {"e": r.normal(0, 0.3, (BUCKETS, DIM)).astype(np.float32), "b": np.full(1, -2.0, dtype=np.float32), "o": r.normal(0, 0.2, FILTERS * len(WIDTHS)).astype(np.float32)}
        self.p["e"][0] = 0
        for w in WIDTHS:
            self.p[f"k{w}"] = r.normal(0, (2 / (w * DIM)) ** 0.5, (w * DIM, FILTERS)).astype(np.float32)
            self.p[f"c{w}"] = np.zeros(FILTERS, dtype=np.float32)
        self.m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        self.t = 0

    def forward(self, ids: np.ndarray, keep: bool = False) -> tuple:
        x = self.p["e"][ids]
        n, length = ids.shape
        pooled, memo = [], []
        for w in WIDTHS:
            m = length - w + 1
            stack = x if w == 1 else np.concatenate([x[:, k : k + m] for k in range(w)], axis=2)
            h = stack.reshape(n * m, w * DIM) @ self.p[f"k{w}"]
            h = h.reshape(n, m, FILTERS) + self.p[f"c{w}"]
            if length > 3:
                h[ids[:, w - 1 :] == 0] = -9.0  # windows that reach into the padding
            at = h.argmax(axis=1) if keep else None
            top = h.max(axis=1)
            pooled.append(np.maximum(top, 0))
            memo.append((stack, at, top))
        z = np.concatenate(pooled, axis=1)
        return z @ self.p["o"] + self.p["b"][0], z, memo

    def score(self, ids: np.ndarray) -> np.ndarray:
        return self.forward(ids)[0]

    def step(self, ids: np.ndarray, y: np.ndarray, weight: np.ndarray, rate: float, drop: np.random.Generator) -> None:
        ids = np.where((drop.random(ids.shape) < 0.1) & (ids > 4), UNKNOWN, ids)
        logit, z, memo = self.forward(ids, keep=True)
        g = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) * weight / len(y)
        g = g.astype(np.float32)
        grads = {"o": z.T @ g + 1e-4 * self.p["o"], "b": np.array([g.sum()], dtype=np.float32)}
        gz = np.outer(g, self.p["o"])
        flat_ids, flat_g = [], []
        n = len(ids)
        for j, w in enumerate(WIDTHS):
            stack, at, top = memo[j]
            gh = gz[:, j * FILTERS : (j + 1) * FILTERS] * (top > 0)
            rows = np.arange(n)[:, None]
            picked = stack[rows, at]  # n, filters, w * DIM
            grads[f"k{w}"] = np.einsum("nfd,nf->df", picked, gh, optimize=True)
            grads[f"c{w}"] = gh.sum(axis=0)
            gx = gh[:, :, None] * self.p[f"k{w}"].T[None]  # n, filters, w * DIM
            for k in range(w):
                flat_ids.append(ids[rows, at + k].ravel())
                flat_g.append(gx[:, :, k * DIM : (k + 1) * DIM].reshape(-1, DIM))
        at = np.concatenate(flat_ids)
        order = np.argsort(at, kind="stable")
        at, grad = at[order], np.concatenate(flat_g)[order]
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        self._adam(grads, at[starts], np.add.reduceat(grad, starts, axis=0), rate)

    def _adam(self, grads: dict, used: np.ndarray, ge: np.ndarray, rate: float) -> None:
        self.t += 1
        fix = (1 - 0.999**self.t) ** 0.5 / (1 - 0.9**self.t)
        for k, g in grads.items():
            m, v = self.m[k]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            self.p[k] -= rate * fix * m / (np.sqrt(v) + 1e-8)
        m, v = self.m["e"]
        m[used] += 0.1 * (ge - m[used])
        v[used] += 0.001 * (ge * ge - v[used])
        self.p["e"][used] -= rate * fix * m[used] / (np.sqrt(v[used]) + 1e-8)
        self.p["e"][0] = 0

    def weights(self) -> dict:
        return dict(self.p)


def score_sentences(net: Network, rows: list[list[int]], batch: int = 4096) -> np.ndarray:
    """Scores of id rows, in batches of similar length."""
    out = np.zeros(len(rows), dtype=np.float32)
    order = sorted(range(len(rows)), key=lambda k: len(rows[k]))
    for i in range(0, len(order), batch):
        part = order[i : i + batch]
        out[part] = net.score(padded([rows[k] for k in part], max(2, len(rows[part[-1]]))))
    return out


def _document_max(scores: np.ndarray, counts: list[int]) -> np.ndarray:
    out, at = np.full(len(counts), -30.0), 0
    for k, n in enumerate(counts):
        if n:
            out[k] = scores[at : at + n].max()
        at += n
    return out


class Classifier:
    """A trained network with its lexicon and thresholds."""

    def __init__(self, lexicon: Lexicon, net: Network, thresholds: dict[str, float], common: float):
        self.lexicon, self.net, self.thresholds, self.common, self.forms = lexicon, net, thresholds, common, WordForms()

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Log-odds of each text's worst sentence; -30 without any words."""
        docs = [sentences(t, self.forms) for t in texts]
        known: dict[tuple[int, ...], int] = {}
        at, counts = [], []
        for d in docs:
            counts.append(len(d))
            for s in d:
                at.append(known.setdefault(tuple(self.lexicon(s)), len(known)))
        if not known:
            return np.full(len(texts), -30.0)
        return _document_max(score_sentences(self.net, [list(k) for k in known])[at], counts)

    def threshold(self, lang: str | None) -> float:
        return self.thresholds.get(lang or "", self.common)


def best_threshold(scores: np.ndarray, y: np.ndarray, slack: float = 0.004) -> float:
    """Middle of the range of thresholds around the highest F1 whose F1 is within ``slack`` of it."""
    order = np.argsort(-scores, kind="stable")
    s, hit = scores[order], np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(s) + 1) + y.sum())
    best = int(f1.argmax())
    low = high = best
    while low > 0 and f1[low - 1] >= f1[best] - slack:
        low -= 1
    while high + 1 < len(s) and f1[high + 1] >= f1[best] - slack:
        high += 1
    below = s[high + 1] if high + 1 < len(s) else s[high] - 2e-3
    return float((s[low] + below) / 2)


@dataclass
class Sample:
    """Labelled documents as id rows of their sentences: ``flat`` sentences, their document, the documents' labels."""

    flat: list[list[int]]
    owner: np.ndarray
    y: np.ndarray

    def counts(self) -> list[int]:
        return np.bincount(self.owner, minlength=len(self.y)).tolist()

    def part(self, keep: np.ndarray) -> Sample:
        """The sample of the documents in the mask."""
        place = np.cumsum(keep) - 1
        own = keep[self.owner]
        return Sample([x for x, ok in zip(self.flat, own.tolist(), strict=True) if ok], place[self.owner[own]], self.y[keep])

    def document_scores(self, net: Network) -> np.ndarray:
        return _document_max(score_sentences(net, self.flat), self.counts())


def fit(sample: Sample, seed: int = 7) -> Network | None:
    """Trains on documents, then on sentences: the worst of a toxic document against those of clean ones. None without both."""
    y, flat, owner = sample.y, sample.flat, sample.owner
    if not 0 < y.sum() < len(y) or not flat:
        return None
    net, rng = Network(seed), np.random.default_rng(seed)
    # A word's evidence of toxicity per document picks the first suspects among the sentences of toxic documents.
    sentence_of = np.repeat(np.arange(len(flat)), [len(x) for x in flat])
    pairs = np.unique(owner[sentence_of] * np.int64(BUCKETS) + np.concatenate([np.asarray(x, dtype=np.int64) for x in flat]))
    toxic = y[pairs // BUCKETS] > 0
    pos, neg = np.bincount(pairs[toxic] % BUCKETS, minlength=BUCKETS), np.bincount(pairs[~toxic] % BUCKETS, minlength=BUCKETS)
    odds = np.log((pos + 0.5) / (y.sum() + 1)) - np.log((neg + 0.5) / (len(y) - y.sum() + 1))
    odds[: EDGE + 1] = 0
    score = np.array([np.sort(odds[x])[-4:].clip(0).sum() for x in flat])
    for stage in range(STAGES):
        if stage:
            score = score_sentences(net, flat)
        order = np.lexsort((score, owner))
        last = np.flatnonzero(np.r_[owner[order][1:] != owner[order][:-1], True])
        worst = order[last]  # per document with sentences its worst one
        chosen = worst[y[owner[worst]] > 0]
        clean = np.flatnonzero(y[owner] == 0)
        if not len(chosen) or not len(clean):
            return None
        hard = clean[np.argsort(-score[clean])[: 4 * len(chosen)]]
        repeat = max(1, round(POSITIVES / len(chosen)))
        for _ in range(2):
            easy = rng.choice(clean, size=min(len(clean), EASY), replace=False)
            picked = np.concatenate([np.repeat(chosen, repeat), hard[:EASY], easy])
            goal = np.concatenate([np.ones(len(chosen) * repeat), np.zeros(len(picked) - len(chosen) * repeat)])
            lengths = np.array([len(flat[k]) for k in picked]) // 4
            by_length = np.lexsort((rng.random(len(picked)), lengths))
            batches = [by_length[i : i + 128] for i in range(0, len(by_length), 128)]
            rng.shuffle(batches)
            for b in batches:
                ids = padded([flat[picked[k]] for k in b], max(2, max(len(flat[picked[k]]) for k in b)))
                net.step(ids, goal[b], np.ones(len(b)), 0.004 if stage < 2 else 0.0015, rng)
    return net


def trusted(sample: Sample, held_out: np.ndarray) -> np.ndarray:
    """Mask of the documents whose label the models trained without them do not contradict.

    The border is the one with the highest F1 on the held-out scores; toxic documents far below it, where plain texts are,
    and clean ones above it are taken for errors of their raters. Toxic ones in between may be of a rare kind and stay.
    """
    border = best_threshold(held_out, sample.y)
    return np.where(sample.y > 0, held_out > border - DOUBT[0], held_out <= border + DOUBT[1])


def calibrated(held_out: np.ndarray, y: np.ndarray, langs: list[str | None]) -> tuple[dict[str, float], float]:
    """Thresholds per language and the common one, from scores of documents by models that did not see them."""
    common, thresholds = best_threshold(held_out, y), {}
    for lang in {x or "" for x in langs}:
        mine = np.array([(x or "") == lang for x in langs])
        if mine.sum() >= MIN_LANG and min(y[mine].sum(), (1 - y[mine]).sum()) >= 15:
            share = mine.sum() / (mine.sum() + 400)
            thresholds[lang] = share * best_threshold(held_out[mine], y[mine]) + (1 - share) * common
    return thresholds, common


def encoded(texts: list[str], labels: list[float], lexicon: Lexicon | None = None) -> tuple[Sample, Lexicon]:
    """Documents as a sample; ``labels`` are mean ratings between 0 and 1, ties count as clean."""
    forms = WordForms()
    docs = [sentences(t, forms) for t in texts]
    lexicon = lexicon or Lexicon(docs)
    return Sample([lexicon(x) for d in docs for x in d], np.repeat(np.arange(len(docs)), [len(d) for d in docs]), np.array([1.0 if x > 0.5 else 0.0 for x in labels])), lexicon


def train(texts: list[str], langs: list[str | None], labels: list[float], run: Callable | None = None, folds: int = FOLDS) -> Classifier | None:
    """The classifier; None without both kinds of labels.

    ``run`` applies a function to each of some numbers and gives the results in order, by default one after the other here;
    with Spark each fit is a task of its own. Folds score documents that their model did not see: these scores show rater
    errors, and calibrate the thresholds.
    """
    sample, lexicon = encoded(texts, labels)
    toxic = sample.y > 0
    fold = np.where(toxic, np.cumsum(toxic), np.cumsum(~toxic)) % folds  # each fold has its share of both
    run = run or (lambda f, numbers: [f(k) for k in numbers])

    def held_out(k: int) -> np.ndarray | None:
        net = fit(sample.part(fold != k))
        return None if net is None else sample.part(fold == k).document_scores(net)

    parts = run(held_out, range(folds))
    if any(p is None for p in parts):
        return None
    scores = np.empty(len(sample.y))
    for k, p in enumerate(parts):
        scores[fold == k] = p
    kept = trusted(sample, scores)

    def whole(_: int) -> Network | None:
        return fit(sample.part(kept))

    (net,) = run(whole, range(1))
    if net is None:
        return None
    thresholds, common = calibrated(scores[kept], sample.y[kept], [x for x, ok in zip(langs, kept.tolist(), strict=True) if ok])
    return Classifier(lexicon, net, thresholds, common)


def in_tasks(spark: SparkSession) -> Callable:
    """Runs a function for each number in a task of its own; the sample travels as one broadcast of bounded size."""

    def run(f: Callable, numbers: range) -> list:
        shared = spark.sparkContext.broadcast(cloudpickle.dumps(f))

        def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = pickle.loads(shared.value)
            for batch in batches:
                for k in batch["id"]:
                    yield pd.DataFrame({"id": [k], "result": [pickle.dumps(own(int(k)))]})

        rows = spark.range(len(numbers)).repartition(len(numbers), "id").mapInPandas(one, "id long, result binary").collect()
        return [pickle.loads(r.result) for r in sorted(rows, key=lambda r: r.id)]

    return run


def labelled_sample(documents: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> pd.DataFrame:
    """text, lang and mean rating of at most ``limit`` labelled documents, in an order that depends on their ids alone."""
    rated = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.avg("toxic").alias("rating"))
    rated = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = documents.select("doc_id", "text", "lang").join(F.broadcast(rated), "doc_id").filter("text IS NOT NULL")
    return rows.toPandas().sort_values("doc_id", kind="stable").drop_duplicates("doc_id")


def score_documents(documents: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, source, lang, score (0 to 1) and flagged of every document."""
    sample = labelled_sample(documents, labels, limit)
    model = train(sample["text"].tolist(), sample["lang"].tolist(), sample["rating"].tolist(), in_tasks(documents.sparkSession)) if len(sample) else None
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in batches:
            logit = own.score(batch["text"].tolist()) if own is not None else np.full(len(batch), -30.0)
            border = np.array([own.threshold(x) for x in batch["lang"]]) if own is not None else np.full(len(batch), np.inf)
            out = batch[["doc_id", "source", "lang"]].copy()
            out["score"] = np.where(logit <= -30, 0.0, 1 / (1 + np.exp(-np.clip(logit, -30, 30)))).round(6)
            out["flagged"] = logit > border
            yield out

    return documents.select("doc_id", "source", "lang", "text").mapInPandas(run, "doc_id long, source string, lang string, score double, flagged boolean")


def rates_by_source(scored: DataFrame) -> DataFrame:
    return scored.groupBy("source").agg(F.count("*").alias("n_docs"), F.count_if("flagged").alias("n_flagged"), F.round(F.avg("score"), 4).alias("mean_score")).withColumn("rate", F.round(F.col("n_flagged") / F.col("n_docs"), 6))
