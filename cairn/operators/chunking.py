"""Semantic chunks: recursive segments with exact spans, then dynamic programming or greedy grouping.

Segments come from separators tried from paragraph to character. With vectors, neighbouring segments are grouped so that
the summed similarity inside chunks is greatest, none exceeds the limit, and none but the last is below the minimum where
that is possible. The sum of a range's similarities follows from the running sums of the vectors, so no matrix of all pairs
is needed and documents of any length are grouped alike; only with ``max_segments`` longer ones break greedily where
similarity is below its 25th percentile. Without vectors the grouping goes by size alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATORS = ("\n\n", "\n", ". ", "? ", "! ", "; ", ", ", " ")
STRATEGIES = {"cluster-semantic@1": (400, 50, 50)}  # largest chunk, smallest chunk, segment size, in words


def strategy_columns(version: Column, largest: Column, smallest: Column, segment: Column) -> tuple[Column, Column, Column]:
    """``resolve_strategy`` as expressions."""
    base = STRATEGIES["cluster-semantic@1"]
    of = lambda k: F.coalesce(*[F.when(version == v, sizes[k]) for v, sizes in STRATEGIES.items()], F.lit(base[k]))
    top, low, seg = [F.when(c > 0, c).otherwise(of(k)) for k, c in enumerate((largest, smallest, segment))]
    return top, F.least(low, top), F.least(seg, top)


def resolve_strategy(version: str | None, largest: int | None, smallest: int | None, segment: int | None) -> tuple[int, int, int]:
    """Sizes of a strategy with the request's overrides; impossible combinations are brought into order."""
    base = STRATEGIES.get(version or "", STRATEGIES["cluster-semantic@1"])
    top, low, seg = [int(x) if x is not None and x > 0 else b for x, b in zip((largest, smallest, segment), base, strict=True)]
    return top, min(low, top), min(seg, top)


def words(text: str) -> int:
    return len(text.split())


def segments(text: str, size: int, level: int = 0, start: int = 0) -> list[tuple[int, int]]:
    """Contiguous spans of at most ``size`` words; a span ends with its separator."""
    if words(text) <= size:
        return [(start, start + len(text))] if text else []
    while level < len(SEPARATORS) and SEPARATORS[level] not in text:
        level += 1
    if level == len(SEPARATORS):
        return [(start, start + len(text))]
    sep, out, at = SEPARATORS[level], [], 0
    parts = []
    while at < len(text):
        end = text.find(sep, at)
        end = len(text) if end < 0 else end + len(sep)
        parts.append((at, end))
        at = end
    open_at, used = None, 0
    for a, b in parts:
        n = words(text[a:b])
        if n > size:
            if open_at is not None:
                out.append((start + open_at, start + a))
                open_at = None
            out.extend(segments(text[a:b], size, level + 1, start + a))
            continue
        if open_at is not None and used + n > size:
            out.append((start + open_at, start + a))
            open_at = None
        if open_at is None:
            open_at, used = a, 0
        used += n
    if open_at is not None:
        out.append((start + open_at, start + len(text)))
    return out


def force_split(text: str, chars: int) -> list[str]:
    """Pieces of at most ``chars`` characters for texts without separators, cut behind the last blank where there is one."""
    out, at = [], 0
    while at < len(text):
        end = min(at + max(1, chars), len(text))
        blank = text.rfind(" ", at, end) if end < len(text) else -1
        end = blank + 1 if blank > at else end
        out.append(text[at:end])
        at = end
    return out


def overlapping(sizes: list[int], largest: int, overlap: int) -> list[tuple[int, int]]:
    """Ranges of segments filled up to ``largest`` words; each begins with the last segments of the one before that hold at most ``overlap``.

    A range that cannot take the overlap and its next segment begins with that segment.
    """
    out, start, k, used = [], 0, 0, 0
    while k < len(sizes):
        if k > start and used + sizes[k] > largest:
            out.append((start, k))
            back, carried = k, 0
            while back > start + 1 and carried + sizes[back - 1] <= overlap and carried + sizes[back - 1] + sizes[k] <= largest:
                back -= 1
                carried += sizes[back]
            start, used = back, carried
        used += sizes[k]
        k += 1
    return [*out, (start, len(sizes))] if sizes else out


def overlap_chunks(df: DataFrame, id_col: str, text_col: str, segment: int, largest: int, overlap: int, piece_chars: int = 2000) -> DataFrame:
    """id, chunk_no, start_index, end_index, token_count of recursive segments merged with overlap; longer words are force-split."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, text in zip(b["_id"], b["_t"], strict=True):
                spans = []
                for a, z in segments(text or "", segment):
                    for piece in force_split(text[a:z], piece_chars):
                        spans.append((a, a + len(piece)))
                        a += len(piece)
                sizes = [words(text[a:z]) for a, z in spans]
                for x, y in overlapping(sizes, largest, overlap):
                    rows.append((key, 0, spans[x][0], spans[y - 1][1], sum(sizes[x:y])))
            out = pd.DataFrame(rows, columns=[id_col, "chunk_no", "start_index", "end_index", "token_count"])
            out["chunk_no"] = out.groupby(id_col, dropna=False).cumcount() if len(out) else out["chunk_no"]
            yield out

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).mapInPandas(run, f"{id_col} {kind}, chunk_no int, start_index int, end_index int, token_count int")


def hashed_vectors(texts: list[str], dim: int = 64) -> np.ndarray:
    """Deterministic unit vectors of word counts in hashed dimensions; a stand-in for an embedding model."""
    out = np.zeros((len(texts), dim), dtype=np.float64)
    for k, t in enumerate(texts):
        for w in t.lower().split():
            h = xxhash.xxh32_intdigest(w)
            out[k, h % dim] += 1 if h >> 31 else -1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


def best_groups(vectors: np.ndarray, sizes: list[int], largest: int, smallest: int) -> list[tuple[int, int]] | None:
    """Ranges with the greatest sum of similarities inside them; None if no range of one segment fits."""
    n = len(sizes)
    sums = np.concatenate([np.zeros((1, vectors.shape[1])), np.cumsum(vectors, axis=0)])
    own = np.concatenate([[0], np.cumsum((vectors * vectors).sum(axis=1))])
    total = np.concatenate([[0], np.cumsum(sizes)])
    best, back = [-np.inf] * (n + 1), [-1] * (n + 1)
    best[0] = 0.0
    for end in range(1, n + 1):
        for start in range(end - 1, -1, -1):
            size = total[end] - total[start]
            if size > largest:
                break
            if best[start] == -np.inf or (size < smallest and end < n and best[end] > -np.inf):
                continue
            inside = sums[end] - sums[start]
            value = best[start] + (float(inside @ inside) - (own[end] - own[start])) / 2
            if size < smallest and end < n:
                value -= 1e6  # only where nothing else reaches this point
            if value > best[end]:
                best[end], back[end] = value, start
    if best[n] == -np.inf:
        return None
    out, end = [], n
    while end > 0:
        out.append((back[end], end))
        end = back[end]
    return out[::-1]


def greedy_groups(sizes: list[int], largest: int, smallest: int, similarity: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Ranges filled up to the limit, or broken earlier where neighbours are unlike each other and the minimum is met."""
    border = np.percentile(similarity, 25) if similarity is not None and len(similarity) else -np.inf
    out, start, used = [], 0, 0
    for k, n in enumerate(sizes):
        unlike = similarity is not None and k > 0 and similarity[k - 1] < border and used >= smallest
        if k > start and (used + n > largest or unlike):
            out.append((start, k))
            start, used = k, 0
        used += n
    return [*out, (start, len(sizes))] if sizes else out


def chunk(text: str | None, version: str | None = None, largest: int | None = None, smallest: int | None = None, segment: int | None = None, embed: Callable[[list[str]], np.ndarray] | None = hashed_vectors, max_segments: int | None = None) -> list[tuple[int, int, int, str]]:
    """(start, end, words, strategy) of each chunk; spans are exact, blank chunks are dropped."""
    if not text or not text.strip():
        return []
    top, low, seg = resolve_strategy(version, largest, smallest, segment)
    spans = segments(text, seg)
    pieces = [text[a:b] for a, b in spans]
    sizes = [words(p) for p in pieces]
    try:
        vectors = embed(pieces) if embed is not None else None
    except Exception:  # a failing model leaves the grouping to the sizes
        vectors = None
    if vectors is None or len(vectors) != len(pieces):
        groups, label = greedy_groups(sizes, top, low), "greedy-tokens"
    elif max_segments is not None and len(pieces) > max_segments:
        groups, label = greedy_groups(sizes, top, low, (vectors[:-1] * vectors[1:]).sum(axis=1)), "greedy-semantic"
    else:
        groups, label = best_groups(vectors, sizes, top, low), "semantic-dp"
        if groups is None:
            groups, label = greedy_groups(sizes, top, low), "greedy-tokens"
    return [(spans[a][0], spans[b - 1][1], sum(sizes[a:b]), label) for a, b in groups if text[spans[a][0] : spans[b - 1][1]].strip()]


def chunk_texts(df: DataFrame, id_col: str, text_col: str, version: Column, largest: Column, smallest: Column, segment: Column, embed: Callable | None = hashed_vectors) -> DataFrame:
    """id, chunk_no, start_index, end_index, token_count, strategy; texts stay in the JVM and are cut by offsets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = lambda x: None if pd.isna(x) else int(x)
        for b in batches:
            rows = [(key, k, *c) for key, t, v, x, y, z in zip(b["_id"], b["_t"], b["_v"], b["_a"], b["_b"], b["_c"], strict=True) for k, c in enumerate(chunk(t, v, number(x), number(y), number(z), embed))]
            yield pd.DataFrame(rows, columns=[f.name for f in schema])

    fields = (("chunk_no", T.IntegerType()), ("start_index", T.IntegerType()), ("end_index", T.IntegerType()), ("token_count", T.IntegerType()), ("strategy", T.StringType()))
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *[T.StructField(n, k) for n, k in fields]])
    return df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), version.alias("_v"), largest.alias("_a"), smallest.alias("_b"), segment.alias("_c")).mapInPandas(run, schema)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def adjacent_similarity(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Cosine of each vector with the next one by id; an equi-join, so no global window."""
    a = vectors.select(id_col, F.col(vector_col).alias("_a"))
    b = vectors.select((F.col(id_col) - 1).alias(id_col), F.col(vector_col).alias("_b"))
    return a.join(b, id_col).select(id_col, cosine(F.col("_a"), F.col("_b")).alias("similarity"))


def block_similarities(vectors: DataFrame, id_col: str, vector_col: str, block: int = 16) -> DataFrame:
    """Similarity of all pairs within blocks of consecutive ids (the segments of one document)."""
    v = vectors.withColumn("block", F.floor(F.col(id_col) / block))
    a = v.select("block", F.col(id_col).alias("a_id"), F.col(vector_col).alias("_a"))
    b = v.select("block", F.col(id_col).alias("b_id"), F.col(vector_col).alias("_b"))
    return a.join(b, "block").filter("a_id < b_id").select("block", "a_id", "b_id", cosine(F.col("_a"), F.col("_b")).alias("similarity"))


def section_headings(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Headings outside code fences with their character offsets: id, offset, heading."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, text in zip(b["_id"], b["_t"], strict=True):
                at, fenced = 0, False
                for line in (text or "").split("\n"):
                    s = line.strip()
                    if s.startswith(("```", "~~~")):
                        fenced = not fenced
                    level = len(s) - len(s.lstrip("#"))
                    if not fenced and 1 <= level <= 6 and s[level : level + 1] == " " and len(s.encode()) <= 512:
                        rows.append((key, at, s[level:].strip()))
                    at += len(line) + 1
            yield pd.DataFrame(rows, columns=[id_col, "offset", "heading"])

    return df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).mapInPandas(run, T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("offset", T.IntegerType()), T.StructField("heading", T.StringType())]))


def nearest_heading(spans: DataFrame, headings: DataFrame, key_col: str, start_col: str) -> DataFrame:
    """As-of join: the last heading at or before each span's start; an equi-join with a maximum, bounded by a page's headings."""
    h = headings.select(F.col(key_col).alias("_k"), "offset", "heading").distinct()
    listed = h.groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("offset", "heading"))).alias("_h"))
    joined = spans.join(listed, F.col(key_col) == F.col("_k"), "left")
    last = F.try_element_at(F.filter("_h", lambda x: x["offset"] <= F.col(start_col)), F.lit(-1))
    return joined.withColumn("nearest_heading", last["heading"]).drop("_k", "_h")
