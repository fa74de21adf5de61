"""Encoding of whole corpora with a public byte-level BPE vocabulary, and decoding back to text.

``Transducer`` encodes left to right and never looks at the whole input: for every prefix it keeps only the last token of
that prefix's encoding. A token may end a prefix if the encoding of the last token before it and of itself does not
merge them further, and exactly one token of those that end there qualifies. A later token can start at most the longest
token's length back, so all that precedes the common ancestor of the last ``lookahead`` prefixes is stable and emitted;
the memory stays within a constant times that lookahead, which is computed from the merge list.

Text is first cut by the vocabulary's public pattern; repeated pieces are remembered up to a bound. No special tokens.

Defined results: null and empty texts give an empty list; special strings in a text are ordinary text; decoding replaces
malformed bytes by U+FFFD; other columns of the input are ignored; repeated ids keep their rows.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pre-tokenisation pattern of this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
REMEMBERED = 400_000


class Vocabulary:
    """Ranks of a byte-level BPE vocabulary, with the tables the transducer needs."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {v: k for k, v in ranks.items()}
        #: Tokens by their bytes read backwards: nested dicts, the key -1 holds the id.
        self.backward: dict = {}
        for token, rank in ranks.items():
            node = self.backward
            for b in reversed(token):
                node = node.setdefault(b, {})
            node[-1] = rank
        self.lookahead = max(map(len, ranks)) - 1
        self.compatible = functools.lru_cache(2_000_000)(self._compatible)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})

    def merge(self, data: bytes) -> list[int]:
        """Plain BPE by lowest rank first, leftmost first; for pairs of tokens only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(((self.ranks.get(a + b, 1 << 31), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
            if best[0] == 1 << 31:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def _compatible(self, left: int, right: int) -> bool:
        return self.merge(self.tokens[left] + self.tokens[right]) == [left, right]


class Transducer:
    """Streaming encoder of one pre-token: ``feed`` bytes, collect stable tokens, ``finish``."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.window = bytearray()  # bytes since the last emitted token
        self.last: list[int] = [-1]  # last token of every prefix of the window
        self.before = -1  # last token emitted

    def _step(self) -> None:
        node, at = self.v.backward, len(self.window)
        i, found = at, -1
        while i > 0:
            node = node.get(self.window[i - 1])
            if node is None:
                break
            i -= 1
            token = node.get(-1)
            if token is None:
                continue
            prev = self.last[i] if i else self.before
            if (i == 0 or prev >= 0) and (prev < 0 or self.v.compatible(prev, token)):
                found = token
                break
        self.last.append(found)

    def feed(self, data: bytes) -> Iterator[int]:
        limit = 4 * (self.v.lookahead + 1)
        for b in data:
            self.window.append(b)
            self._step()
            if len(self.window) >= limit:
                yield from self._stable()

    def _path(self, end: int) -> list[int]:
        """Ends of the tokens of the prefix ``end``, from its end back to the window's start."""
        ends = []
        while end > 0:
            ends.append(end)
            end -= len(self.v.tokens[self.last[end]])
        return ends

    def _stable(self) -> Iterator[int]:
        at = len(self.window)
        common: set[int] | None = None
        for end in range(at - self.v.lookahead, at + 1):
            if self.last[end] >= 0:
                own = set(self._path(end))
                common = own if common is None else common & own
        if common:
            yield from self._emit(max(common))

    def _emit(self, upto: int) -> list[int]:
        out = [self.last[e] for e in reversed(self._path(upto))]
        self.before = out[-1] if out else self.before
        self.window = self.window[upto:]
        self.last = [-1, *self.last[upto + 1 :]]
        return out

    def finish(self) -> list[int]:
        return self._emit(len(self.window)) if self.window else []


class Encoder:
    """Texts to ids. Pieces met before are remembered up to ``remembered`` entries."""

    def __init__(self, vocabulary: Vocabulary, pattern: str = PATTERN, remembered: int = REMEMBERED):
        self.v, self.cut, self.remembered = vocabulary, regex.compile(pattern), remembered
        self.known: dict[str, tuple[int, ...]] = {}

    def piece(self, text: str) -> tuple[int, ...]:
        data = text.encode("utf-8", "replace")
        whole = self.v.ranks.get(data)
        if whole is not None:
            return (whole,)
        machine = Transducer(self.v)
        return (*machine.feed(data), *machine.finish())

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        known, out = self.known, []
        for part in self.cut.findall(text):
            ids = known.get(part)
            if ids is None:
                ids = self.piece(part)
                if len(part) <= 64:
                    if len(known) >= self.remembered:
                        known.clear()
                    known[part] = ids
            out.append(ids)
        return list(chain.from_iterable(out))


class Utf8Machine:
    """Incremental bytes to text: keeps at most three pending bytes between calls."""

    def __init__(self):
        self.pending = b""

    def feed(self, data: bytes) -> str:
        data, out, i = self.pending + data, [], 0
        n = len(data)
        while i < n:
            b = data[i]
            need, low, high = (0, 0, 0) if b < 0x80 else (1, 0x80, 0xBF) if 0xC2 <= b <= 0xDF else (2, 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF) if 0xE0 <= b <= 0xEF else (3, 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF) if 0xF0 <= b <= 0xF4 else (-1, 0, 0)
            if need < 0:
                out.append("�")
                i += 1
                continue
            k = 1
            while k <= need and i + k < n and (low if k == 1 else 0x80) <= data[i + k] <= (high if k == 1 else 0xBF):
                k += 1
            if k > need:
                out.append(data[i : i + k].decode("utf-8"))
            elif i + k >= n:
                break
            else:
                out.append("�")
            i += k
        self.pending = data[i:]
        return "".join(out)

    def finish(self) -> str:
        left, self.pending = self.pending, b""
        return "�" if left else ""


def decode(ids: Iterable[int], vocabulary: Vocabulary) -> str:
    machine = Utf8Machine()
    return "".join(machine.feed(vocabulary.tokens[i]) for i in ids) + machine.finish()


@functools.lru_cache(4)
def encoder(path: str) -> Encoder:
    """The encoder of a worker process; loaded once per process from a path every executor has."""
    return Encoder(Vocabulary.load(path))


def encode_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """id and ``ids`` of every row. No shuffle: texts are encoded where they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch in batches:
            lists = [encode(t) for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(lists) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            flat = pa.array(np.fromiter(chain.from_iterable(lists), dtype=np.int32, count=int(offsets[-1])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=[id_col, "ids"])

    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def decode_documents(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """id and ``text`` of every row of ids; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = encoder(vocabulary).v
        for batch in batches:
            texts = [None if x is None else decode(x, v) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("text", T.StringType())])
    return df.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, schema)
