"""Oversized texts cut into pieces under a limit, at natural boundaries, with an overlap.

Agglomerative: a text starts as atomic segments (sentences; where one is too long its clauses, then runs of words).
Adjacent pairs wait in a heap, the weakest boundary first (words, clause, sentence, line, paragraph, heading), and are
merged while their size plus the overlap fits. A pair that does not fit is dropped for good, since sizes only grow.
Consecutive pieces share exactly the given number of words (fewer only where the text before is shorter).

Defined results: tokens are runs without Unicode white space; null or blank texts give no piece; a text within its limit
is one piece; a missing, zero or negative limit is the default; an overlap is kept below the limit, null or negative is
none; a single token longer than any limit stays whole, as it counts once; repeated requests are cut alike.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.text import TOKEN

DEFAULT_LIMIT = 400
WORDS, CLAUSE, SENTENCE, LINE, PARAGRAPH, HEADING = range(1, 7)
SENTENCE_END = re.compile(r"[.!?…。！？؟][\"'”’»)\]]*$")
CLAUSE_END = re.compile(r"[,;:–—][\"'”’»)\]]*$")
BREAKS = re.compile(r"\r\n|[\n\r\x0b\x0c\x85  ]")

PIECE_FIELDS = [
    T.StructField("piece_no", T.IntegerType()),
    T.StructField("start_index", T.IntegerType()),
    T.StructField("end_index", T.IntegerType()),
    T.StructField("piece_text", T.StringType()),
    T.StructField("token_count", T.IntegerType()),
    T.StructField("overlap_count", T.IntegerType()),
]


def strength(text: str, left: tuple[int, int], right: tuple[int, int]) -> int:
    """How natural a cut between two neighbouring tokens is."""
    gap = text[left[1] : right[0]]
    breaks = len(BREAKS.findall(gap)) if gap != " " else 0
    if breaks:
        if text[right[0]] == "#":
            return HEADING
        return PARAGRAPH if breaks > 1 or " " in gap else LINE
    word = text[max(left[0], left[1] - 12) : left[1]]
    if SENTENCE_END.search(word):
        return SENTENCE
    return CLAUSE if CLAUSE_END.search(word) else WORDS


def atoms(cuts: list[int], n: int, room: int) -> list[tuple[int, int]]:
    """Token ranges of the atomic segments; ``cuts[i]`` is the strength of the boundary after token i."""

    def split(lo: int, hi: int, least: int) -> list[tuple[int, int]]:
        out, start = [], lo
        for i in range(lo, hi):
            if i == hi - 1 or cuts[i] >= least:
                out.append((start, i + 1))
                start = i + 1
        return out

    found = []
    for a in split(0, n, SENTENCE):
        if a[1] - a[0] <= room:
            found.append(a)
            continue
        for b in split(*a, CLAUSE):
            if b[1] - b[0] <= room:
                found.append(b)
            else:
                found.extend((k, min(k + room, b[1])) for k in range(b[0], b[1], room))
    return found


def merge(segments: list[tuple[int, int]], cuts: list[int], room: int) -> list[tuple[int, int]]:
    """Merges neighbours over the weakest boundaries first while the result fits ``room``."""
    n = len(segments)
    start, end = [s for s, _ in segments], [e for _, e in segments]
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    alive = [True] * n
    heap = [(cuts[end[i] - 1], end[i + 1] - start[i], i, i + 1) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        _, size, i, j = heapq.heappop(heap)
        if not (alive[i] and alive[j] and after[i] == j and size == end[j] - start[i]) or size > room:
            continue
        end[i], after[i], alive[j] = end[j], after[j], False
        if after[i] >= 0:
            before[after[i]] = i
            heapq.heappush(heap, (cuts[end[i] - 1], end[after[i]] - start[i], i, after[i]))
        if before[i] >= 0:
            p = before[i]
            heapq.heappush(heap, (cuts[end[p] - 1], end[i] - start[p], p, i))
    return [(start[i], end[i]) for i in range(n) if alive[i]]


def split_text(text: str | None, limit: int | None, overlap: int | None) -> list[tuple[int, int, int, int]]:
    """(start, end) character offsets, token count and overlapping tokens of each piece."""
    if not text:
        return []
    spans = [m.span() for m in TOKEN.finditer(text)]
    if not spans:
        return []
    limit = limit if limit is not None and limit > 0 else DEFAULT_LIMIT
    if len(spans) <= limit:
        return [(spans[0][0], spans[-1][1], len(spans), 0)]
    shared = min(max(overlap or 0, 0), limit - 1)
    room = limit - shared
    cuts = [strength(text, a, b) for a, b in zip(spans, spans[1:], strict=False)] + [HEADING]
    out = []
    for lo, hi in merge(atoms(cuts, len(spans), room), cuts, room):
        first = max(0, lo - shared)
        out.append((spans[first][0], spans[hi - 1][1], hi - first, lo - first))
    return out


def split_pieces(df: DataFrame, id_col: str, text_col: str, limit_col: F.Column, overlap_col: F.Column) -> DataFrame:
    """One row per piece: id, piece_no (from 1), start_index, end_index, piece_text, token_count, overlap_count."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text, limit, overlap in zip(batch["_id"], batch["_text"], batch["_limit"], batch["_overlap"], strict=True):
                for k, (a, b, n, o) in enumerate(split_text(text, None if pd.isna(limit) else int(limit), None if pd.isna(overlap) else int(overlap)), 1):
                    rows.append((key, k, a, b, text[a:b], n, o))
            yield pd.DataFrame(rows, columns=[f.name for f in schema])

    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *PIECE_FIELDS])
    return df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), limit_col.alias("_limit"), overlap_col.alias("_overlap")).mapInPandas(run, schema)
