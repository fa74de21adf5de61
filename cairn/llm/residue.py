"""Template residue, filler, error pages and script notices in place of content.

A naive Bayes model over passages (sentences and headings outside of code) learns from positive and unlabelled records by
expectation-maximization. Trusted records: reviewed ones with a drop rule of these kinds are positive, other reviewed
ones negative, the rest unlabelled. In each round every unlabelled passage counts by its current probability; in a
positive record its most likely passage counts fully and the others count as sound (headings and sentences around it). Counts are sums over all
rows, in a hashed feature space of fixed size, added in shuffles; only these sums reach the driver. A record is a case if
one of its passages is.

Features are words, pairs of neighbouring words, and the shapes of unfilled placeholders; names and numbers are masked.
Code (fenced or inline) and page furniture are left out, so texts about such things and plain menus are no cases.

Defined results: null and blank texts are no case; repeated rows each get their result; very long texts are read whole;
without any positive record nothing is found; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.maincontent import MD_LINK
from cairn.llm.neardup import FAN, folded
from cairn.session import checkpoint

#: Drop rules that mark records of this kind.
RULES = ("template_residue", "filler_text", "error_page", "script_notice")
BUCKETS, PART, ROUNDS, SMOOTH, CAP = 1 << 18, 1 << 16, 5, 1.0, 6.0
BORDER = 0.0

FENCED = re.compile(r"(?ms)^\s*(```|~~~).*?(?:^\s*\1[^\n]*$|\Z)")
INLINE = re.compile(r"(`+)(?!`).+?(?<!`)\1(?!`)", re.S)
LINE_LEAD = re.compile(r"^[\s>#*+•|-]*(?:\d{1,3}[.)]\s+)?")
SENTENCE = re.compile(r"(?<=[.!?])[\"'”’»)]*\s+")
PLACEHOLDERS = [
    ("@double", re.compile(r"\{\{[^{}\n]{0,80}\}\}")),
    ("@block", re.compile(r"\{%[^%\n]{0,80}%\}")),
    ("@erb", re.compile(r"<%[^%\n]{0,80}%>")),
    ("@dollar", re.compile(r"[$#]\{[^{}\n]{1,80}\}")),
    ("@square", re.compile(r"\[\[[^\[\]\n]{1,80}\]\]")),
    ("@insert", re.compile(r"\[(?:INSERT|YOUR|ENTER|ADD|PLACEHOLDER|TODO|TBD)\b[^\[\]\n]{0,60}\]", re.I)),
    ("@single", re.compile(r"\{[A-Za-z_][\w.]{0,60}\}")),
    ("@percent", re.compile(r"%[A-Z][A-Z_]{2,40}%|%\([a-z_]+\)s")),
    ("@under", re.compile(r"__[A-Z][A-Z_]{1,40}__")),
    ("@empty", re.compile(r"<(?:your|insert|enter) [^<>\n]{1,60}>", re.I)),
]
MAYBE = re.compile(r"[{}%\[]|__|<")
TOKENS = re.compile(r"@[a-z]+|\d[\d.,]*|[^\W_]+(?:['’][^\W_]+)*|…|\.\.\.")
#: Prompts to share, print or comment, in English, German, French and Spanish.
SHARING = re.compile(
    r"^(?:(?:share(?: this page)?|tweet|print|copy link|send by e-?mail|leave a comment|\d+ comments?|teilen|drucken|link kopieren|per e-?mail senden|kommentar schreiben|\d+ kommentare?|partager|imprimer|copier le lien|envoyer par e-?mail|commenter|\d+ commentaires?|compartir|imprimir|copiar enlace|enviar por correo|comentar|\d+ comentarios?|accept all|reject|ok, got it|save my choice|manage options|alle akzeptieren|ablehnen|einstellungen|tout accepter|refuser|paramétrer|aceptar todo|rechazar|configurar)\s*)+$",
    re.I,
)
HEX = re.compile(r"(?=[0-9a-f]*\d)[0-9a-f]{6,}$")


#: Wording of page furniture in English, German, French and Spanish. A consent, promotion or footer phrase
#: needs the reader or the site as its subject, so that reports about cookies or newsletters do not match.
CONSENT_TOPIC = r"cookies?|trackers?|traceurs?|consent|partners store|partenaires enregistrent|socios guardan|partner speichern|privatsph|privacy matters|vie privée|privacidad|save[sd]? preferences|einwilligung"
CONSENT_VOICE = r"\b(?:we|our|us|your?|this site|ce site|este sitio|nous|vous|votre|vos|su|nos|acepta|elija|usamos|utilizamos|ihre[mnrs]?|sie|wir|uns|diese website|choose|accept|help us)\b"
PHRASES = (
    r"store (?:and access )?information on your device", r"enregistrent des données sur votre", r"guardan datos en su", r"speichern .{0,40}auf ihrem gerät", r"stimmen sie .{0,40}zu\b", r"some cookies are needed",
    r"certains cookies sont", r"algunas cookies son", r"einige cookies sind",
    r"like what you read", r"sign up for our", r"subscribe (?:to|for|now)", r"you have \d+ free articles?", r"free articles left", r"^support \S+ from", r"cents a day", r"in your inbox", r"^article continues below", r"^advertisement$", r"^sponsored",
    r"inscrivez-vous", r"abonnez-vous", r"recevez chaque", r"il vous reste \d+ articles?", r"^soutenez", r"centimes par jour", r"la suite de l'article", r"^publicité$", r"vous aimez ce que",
    r"suscríbase", r"reciba cada", r"le quedan \d+ artículos?", r"^apoye", r"céntimos al día", r"el artículo continúa", r"^publicidad$", r"le gusta lo que",
    r"jetzt den .{0,30}bestellen", r"newsletter bestellen", r"jede woche per e-?mail", r"sie haben noch \d+ freie", r"^unterstützen sie", r"cent (?:am|pro) tag", r"artikel geht .{0,20}weiter", r"^anzeige$", r"gefällt ihnen",
    r"^©", r"^\(c\) \d{4}", r"^copyright\b", r"^all rights reserved", r"^tous droits réservés", r"^todos los derechos reservados", r"^alle rechte vorbehalten", r"^powered by", r"^registered office", r"^follow us on",
    r"not responsible for the content of external", r"n'est pas responsable des sites", r"no responde de los sitios", r"für inhalte fremder", r"haftet .{0,30}nicht\.?$", r"^privacy policy\s*[·|]", r"^impressum\s*[·|]", r"^mentions légales\s*[·|]", r"^aviso legal\s*[·|]",
    r"^back to top", r"^haut de page", r"^nach oben", r"^volver arriba", r"^siège social", r"^domicilio social", r"^sitz der gesellschaft", r"^propulsé par", r"^suivez-nous", r"^síganos", r"^folgen sie uns",
)
#: Labels over lists of other articles.
LABELS = re.compile(
    r"^(?:related (?:stories|articles|posts|content)|you may also like|most read|most popular|more from .{0,40}|latest|read (?:more|next|also)|à lire aussi|les plus lus|sur le même thème|meistgelesen|mehr zum thema.{0,40}|das könnte sie (?:auch )?interessieren|lo más leído|le puede interesar|más sobre .{0,40}|table of contents|share this page|comments?)\W*$",
    re.I,
)
FURNITURE = re.compile("|".join(PHRASES), re.I)
TOPIC, VOICE = re.compile(CONSENT_TOPIC, re.I), re.compile(CONSENT_VOICE, re.I)


def _triggers() -> ahocorasick.Automaton:
    """One plain substring of every phrase and topic: a line without any of them needs no pattern."""
    found = ahocorasick.Automaton()
    for pattern in (*PHRASES, *CONSENT_TOPIC.split("|")):
        plain = re.findall(r"[^\W\d_][^\W\d_' -]*(?:[ '-][^\W\d_]+)*", re.sub(r"\\.|\[.*?\]\??|\(\?:.*?\)\??|.[?*]|\{.*?\}", "\0", pattern)) or ["©"]
        literal = max(plain, key=len) if len(max(plain, key=len)) > 2 else "(c)"
        found.add_word(literal, literal)
    found.make_automaton()
    return found


TRIGGERS = _triggers()


def is_furniture(sentence: str) -> bool:
    if next(TRIGGERS.iter(sentence.lower()), None) is None:
        return False
    return bool(FURNITURE.search(sentence)) or bool(TOPIC.search(sentence) and VOICE.search(sentence))


def _is_menu(lines: list[str]) -> bool:
    """A block of page furniture: separators of menus and paths, sharing prompts, or several short labels."""
    if any(is_furniture(x) for x in lines) or LABELS.match(lines[0]):
        return True
    if all("›" in x or " · " in x or SHARING.match(x) for x in lines):
        return True
    return len(lines) > 1 and all(len(x.split()) <= 12 and "@" not in x and not any(c.isdigit() for c in LINE_LEAD.sub("", x)) and x[-1] not in ".!?…:;,>" for x in lines)


def passages(text: str | None) -> list[str]:
    """Sentences and headings of a text, without code, tables, link targets and page furniture.

    Placeholders stand as their shapes; each also is a passage of its own, as it may sit in an otherwise sound sentence.
    """
    if text is None or not text.strip():
        return []
    if "`" in text or "~~~" in text:
        text = INLINE.sub(" ", FENCED.sub("\n", text))
    out: list[str] = []
    headings: list[str] = []  # they decide only where nothing else stands
    block: list[str] = []
    for line in (*text.split("\n"), ""):
        line = line.strip()
        if line:
            if line[0] == "|" and line.count("|") > 1:
                continue
            if MAYBE.search(line):
                if "](" in line:
                    bare = MD_LINK.sub("", line)
                    if sum(c.isalpha() for c in bare) < 0.4 * sum(c.isalpha() for c in MD_LINK.sub(r"\1", line)):
                        continue
                    line = MD_LINK.sub(r"\1", line)
                for name, shape in PLACEHOLDERS:
                    line, n = shape.subn(f" {name} ", line)
                    if n:
                        out.append(name)
            block.append(line.strip())
            continue
        if block and not _is_menu(block):
            for x in block:
                (headings if x[0] == "#" else out).extend(s for s in SENTENCE.split(LINE_LEAD.sub("", x).strip()) if s)
        block = []
    return out or headings


def is_capital(w: str, position: int, shout: bool) -> bool:
    """Whether a token looks like a name where it stands."""
    return position > 0 and w[0].isupper() and not shout and not w.isupper()


def masked(w: str, position: int, shout: bool, capitals: frozenset[str]) -> str:
    """The form of a token: numbers and names are masked, but not the capitalised words that such notices use."""
    if w[0] == "@":
        return w
    if HEX.match(w.lower()):
        return "#hex"
    if w[0].isdigit():
        return "#status" if len(w) == 3 and w[0] in "45" and w.isdigit() else "#n"
    if is_capital(w, position, shout):
        return "#name:" + w.lower() if w.lower() in capitals else "#name"
    return w.lower()


class Features:
    """Hashed distinct features of passages; forms of tokens and hashes are remembered (bounded)."""

    def __init__(self, capitals: frozenset[str] = frozenset(), limit: int = 400_000):
        self.capitals, self.limit = capitals, limit
        self.first: dict[str, str] = {}
        self.later: dict[str, str] = {}
        self.hashes: dict[str, int] = {}

    def __call__(self, passage: str) -> list[int]:
        if len(self.hashes) + len(self.first) + len(self.later) > self.limit:
            for x in (self.hashes, self.first, self.later):
                x.clear()
        shout = passage.isupper()
        words, known = [], self.first
        later = self.first if shout else self.later  # in a shouted passage no word is a name
        for w in TOKENS.findall(passage):
            form = known.get(w)
            if form is None:
                form = known[w] = masked(w, int(known is not self.first), shout, self.capitals)
            words.append(form)
            known = later
        found = set(words)
        found.update([f"{a} {b}" for a, b in zip(["^", *words], [*words, "$"], strict=True)])
        if passage[-1:] not in ".!?…:;":
            found.add("@open")
        if len(words) <= 3:
            found.add("@short")
        out, hashes = set(), self.hashes
        for f in found:
            h = hashes.get(f)
            if h is None:
                h = hashes[f] = xxhash.xxh32_intdigest(f) % BUCKETS
            out.add(h)
        return sorted(out)


def learn_capitals(positives: DataFrame, text_col: str) -> frozenset[str]:
    """Capitalised words inside passages of at least three and of one in a hundred trusted records: names recur less.

    So many words that a record has a hundred of them at most reach the driver.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [{w.lower() for p in passages(t) for k, w in enumerate(TOKENS.findall(p)) if len(w) > 3 and w[0] != "@" and is_capital(w, k, p.isupper())} for t in batch["text"]]
            yield pd.DataFrame({"word": pd.Series([w for x in found for w in x], dtype="object")})

    texts = positives.select(F.col(text_col).alias("text"))
    least = max(3, texts.count() // 100)
    return frozenset(r.word for r in texts.mapInPandas(run, "word string").groupBy("word").count().filter(F.col("count") >= least).collect())


def _score(lists: list, model: np.ndarray, prior: float) -> np.ndarray:
    return np.array([prior + model[np.asarray(x, dtype=np.int64)].sum() for x in lists])


def _sum_counts(prepared: DataFrame, model: np.ndarray | None, prior: float) -> tuple[np.ndarray, np.ndarray, float, float]:
    """One round over all rows: feature counts of cases and of the rest, and the weight of both."""
    shared = prepared.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        pos, neg, n = np.zeros(BUCKETS, dtype=np.float32), np.zeros(BUCKETS, dtype=np.float32), [0.0, 0.0]
        for batch in batches:
            for label, lists in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not lists:
                    continue
                if known is None:
                    if label < 0:
                        continue
                    weights = np.full(len(lists), label / len(lists))
                elif label == 0:
                    weights = np.zeros(len(lists))
                else:
                    weights = 1 / (1 + np.exp(-np.clip(_score(lists, known, prior), -30, 30)))
                    if label == 1:
                        weights = (np.arange(len(weights)) == weights.argmax()).astype(float)
                for x, w in zip(lists, weights.tolist(), strict=True):
                    at = np.asarray(x, dtype=np.int64)
                    if w > 1e-3:
                        pos[at] += w
                    if w < 0.999:
                        neg[at] += 1 - w
                    n[0] += w
                    n[1] += 1 - w
        for part in range(BUCKETS // PART):
            cut = slice(part * PART, (part + 1) * PART)
            sums = zlib.compress(np.concatenate([pos[cut], neg[cut], [n[0], n[1]] if part == 0 else [0.0, 0.0]]).astype(np.float64).tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([TaskContext.get().partitionId() % FAN], pa.int32()), pa.array([sums], pa.binary())], names=["part", "slot", "counts"])

    parts = prepared.select("label", "lists").mapInArrow(scan, "part int, slot int, counts binary")
    size = 2 * PART + 2
    pos, neg, a, b = np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0
    for row in folded(folded(parts, ["part", "slot"], np.float64, size, np.add), ["part"], np.float64, size, np.add).collect():  # BUCKETS / PART rows
        sums = np.frombuffer(zlib.decompress(row.counts), dtype=np.float64)
        pos[row.part * PART : (row.part + 1) * PART], neg[row.part * PART : (row.part + 1) * PART] = sums[:PART], sums[PART : 2 * PART]
        a, b = a + float(sums[-2]), b + float(sums[-1])
    return pos, neg, a, b


def log_odds(pos: np.ndarray, neg: np.ndarray, a: float, b: float) -> tuple[np.ndarray, float]:
    """Weight of each feature and the prior log-odds; features never seen weigh nothing."""
    share = min(max(a / max(a + b, 1e-9), 1e-6), 1 - 1e-6)
    prior = math.log(share / (1 - share))
    model = np.log((pos + SMOOTH * share) / (neg + SMOOTH * (1 - share))) - prior
    return np.clip(model, -CAP, CAP).astype(np.float32), prior


def train(evidence: DataFrame, text_col: str = "text", rule_col: str = "expected_drop_rule", reviewed_col: str = "agent_useful", rounds: int = ROUNDS) -> tuple[np.ndarray, float, frozenset[str]]:
    """The model (weight per hashed feature, prior, capitalised words of notices) learnt from all rows."""
    capitals = learn_capitals(evidence.filter(F.col(rule_col).isin(*RULES) & F.col(text_col).isNotNull()), text_col)
    label = F.when(F.col(rule_col).isin(*RULES), 1).when(F.col(reviewed_col).isNotNull(), 0).otherwise(-1)

    def prepare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features(capitals)
        for batch in batches:
            yield pd.DataFrame({"label": batch["label"], "lists": [[features(p) for p in passages(t)] for t in batch["text"]]})

    prepared = checkpoint(evidence.filter(F.col(text_col).isNotNull()).select(label.cast("int").alias("label"), F.col(text_col).alias("text")).mapInPandas(prepare, "label int, lists array<array<int>>"))
    model, prior = None, 0.0
    for _ in range(rounds):
        pos, neg, a, b = _sum_counts(prepared, model, prior)
        if a == 0:
            return np.zeros(BUCKETS, dtype=np.float32), -30.0, capitals
        model, prior = log_odds(pos, neg, a, b)
    return model, prior, capitals


class Scorer:
    """Score of a text's most likely passage and that passage. Scores of passages are remembered (bounded), as many recur."""

    def __init__(self, model: np.ndarray, prior: float, capitals: frozenset[str] = frozenset(), limit: int = 200_000):
        self.model, self.prior, self.features, self.limit = model, prior, Features(capitals), limit
        self.known: dict[str, float] = {}

    def __call__(self, text: str | None) -> tuple[float, str | None]:
        if len(self.known) > self.limit:
            self.known.clear()
        top, own = -1e9, None
        for p in passages(text):
            s = self.known.get(p)
            if s is None:
                s = self.known[p] = self.prior + float(self.model[self.features(p)].sum())
            if s > top:
                top, own = s, p
        return top, own


def case_test(spark: SparkSession, model: np.ndarray, prior: float, capitals: frozenset[str], border: float = BORDER) -> Callable[[], Callable[[str], bool]]:
    """What makes, in a task, the test whether a text is a case."""
    shared = spark.sparkContext.broadcast((model, prior, capitals))

    def make() -> Callable[[str], bool]:
        score = Scorer(*shared.value)
        return lambda text: score(text)[0] > border

    return make


def score_records(df: DataFrame, key_cols: list[str], text_col: str, model: np.ndarray, prior: float, capitals: frozenset[str]) -> DataFrame:
    """Key columns, ``score`` (log-odds of the most likely passage) and that passage, for records with any passage."""
    shared = df.sparkSession.sparkContext.broadcast((model, prior, capitals))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = Scorer(*shared.value)
        for batch in batches:
            found = [score(t) for t in batch["_text"]]
            out = batch[key_cols].copy()
            out["score"], out["passage"] = [f[0] for f in found], [f[1] for f in found]
            yield out[np.array([f[1] is not None for f in found], dtype=bool)] if found else out

    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in key_cols) + ", score double, passage string"
    return df.select(*key_cols, F.col(text_col).alias("_text")).mapInPandas(run, schema)


def residue_cases(df: DataFrame, key_cols: list[str], text_col: str, model: np.ndarray, prior: float, capitals: frozenset[str], border: float = BORDER) -> DataFrame:
    return score_records(df, key_cols, text_col, model, prior, capitals).filter(F.col("score") > border).select(*key_cols)
