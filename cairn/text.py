"""Text primitives shared by the operators: words, white space, hashing."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import xxhash

#: The characters with the Unicode property White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
#: The same set as a class for Java regular expressions.
WHITE_CLASS = "[\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"

WORD = re.compile(r"[^\W_]+")
TOKEN = re.compile(f"[^{re.escape(WHITE)}]+")


def words(text: str | None) -> list[str]:
    """Longest runs of letters and digits, lower-cased; null gives none."""
    return WORD.findall(text.lower()) if text else []


def plain_words(text: str | None) -> list[str]:
    """As ``words``, with accents removed first, so composed and decomposed spellings agree."""
    if not text:
        return []
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")
    return WORD.findall(text.lower())


class WordIds:
    """64-bit ids of words, remembered for the words of recent batches (bounded)."""

    def __init__(self, limit: int = 500_000):
        self.known: dict[str, int] = {}
        self.limit = limit

    def __call__(self, tokens: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.limit:
            known.clear()
        get = known.get
        out = []
        for w in tokens:
            h = get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
            out.append(h)
        return np.array(out, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def rolling(ids: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive ids (empty when there are fewer)."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        h = np.full(n, size, dtype=np.uint64)
        for k in range(size):
            h = _mix(h + ids[k : k + n])
    return h
