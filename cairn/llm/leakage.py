"""Evaluation texts leaking into training text: exact containment of item-sized windows, found by prefix filtering.

Every item gives windows of ``window`` consecutive words (one shorter window if it has fewer words). A window is the set
of its shingles in order; a document holds it only if all of them stand there one after the other.

1. The item side gives its windows and one bitmap of their shingles (of bounded size; some other shingles pass it,
   which costs time but changes nothing).
2. One scan of the corpus, whatever the number of items: the document frequency of every item shingle, and the runs of
   words where at least as many consecutive shingles pass the bitmap as a window has (length bound). Only these runs
   leave the scan.
3. Shingles are ordered by document frequency over the whole corpus; a window's prefix is its rarest one. Prefixes and
   the shingles of the runs are joined by hash, the offset in the window fixes where it would have to start, windows
   that would stick out of their run are dropped (positional bound), the rest is compared word by word.

Defined results: words are runs of letters and digits without case and accents; null, empty and wordless texts neither
leak nor hold anything; repeated items and documents each give their own rows; a document appears once per item; null
ids are ids like any other; other columns of the inputs are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.neardup import MAX_ID_BITS, MIN_ID_BITS, id_bits, power_of_two
from cairn.session import checkpoint
from cairn.text import WordIds, plain_words, rolling

WINDOW, SHINGLE = 13, 3


def bits_of(h: np.ndarray, size: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit values for the bitmap from a shingle's hash and the size of the windows it is part of."""
    with np.errstate(over="ignore"):
        x = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD) + np.asarray(size).astype(np.uint64)
        y = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x, y ^ (y >> np.uint64(32))


def item_windows(items: DataFrame, item_id: str, text_col: str, window: int, shingle: int) -> DataFrame:
    """Distinct windows of every item: item, size, words, hashes of its shingles in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = WordIds()
        for batch in batches:
            rows = []
            for key, text in zip(batch["_item"], batch["_text"], strict=True):
                words = plain_words(text)
                size = min(window, len(words))
                hashes = rolling(ids(words), min(shingle, size)).view(np.int64).tolist() if words else []
                known = set()
                for i in range(len(words) - size + 1 if words else 0):
                    own = tuple(words[i : i + size])
                    if own not in known:
                        known.add(own)
                        rows.append((key, size, list(own), hashes[i : i + size - min(shingle, size) + 1]))
                        if len(rows) >= 20_000:
                            yield pd.DataFrame(rows, columns=["item", "size", "words", "hashes"])
                            rows = []
            yield pd.DataFrame(rows, columns=["item", "size", "words", "hashes"])

    schema = T.StructType([T.StructField("item", items.schema[item_id].dataType), T.StructField("size", T.IntegerType()), T.StructField("words", T.ArrayType(T.StringType())), T.StructField("hashes", T.ArrayType(T.LongType()))])
    return items.select(F.col(item_id).alias("_item"), F.col(text_col).alias("_text")).mapInPandas(run, schema)


def _bitmap(windows: DataFrame) -> tuple[list[int], np.ndarray]:
    """The window sizes, and a bitmap of all their shingles: about 32 bits for each, at most ``MAX_ID_BITS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, h = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in bits_of(h.view(np.uint64), size)], names=["a", "b"])

    hashes = windows.select("size", F.explode("hashes").alias("h"))
    counts = {r["size"]: r["n"] for r in hashes.groupBy("size").agg(F.approx_count_distinct("h").alias("n")).collect()}  # at most ``window`` rows
    return sorted(counts), id_bits(hashes.mapInArrow(run, "a long, b long"), power_of_two(32 * sum(counts.values()), MIN_ID_BITS, MAX_ID_BITS))


def _passes(bits: np.ndarray, h: np.ndarray, size: int) -> np.ndarray:
    """Positions of the hashes that pass the bitmap."""
    at = np.arange(len(h))
    for x in bits_of(h, size):
        bit = x[at].view(np.int64) % (8 * len(bits))
        at = at[(bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)]
    return at


def runs_of(at: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(start, end) of the runs of at least ``least`` consecutive numbers."""
    cuts = np.flatnonzero(np.diff(at) != 1) + 1
    starts, ends = at[np.r_[0, cuts]] if len(at) else at, at[np.r_[cuts - 1, len(at) - 1]] + 1 if len(at) else at
    long = ends - starts >= least
    return list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))


def _scan(docs: DataFrame, doc_id: str, text_col: str, windows_of: list[int], bits: np.ndarray, shingle: int) -> DataFrame:
    """The one scan: rows (size, h, n) that count documents per item shingle, and rows (size, doc, words) of runs."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    doc_type = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("size", T.IntegerType()), T.StructField("h", T.LongType()), T.StructField("n", T.LongType()), T.StructField("doc", doc_type), T.StructField("words", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, known = WordIds(), shared.value
        for batch in batches:
            texts = [plain_words(t) for t in batch.column(1).to_pylist()]
            own = [ids(w) for w in texts]
            sizes, at, found = [], [], []
            counts = []
            for part in sorted({min(shingle, size) for size in windows_of}):
                # All hashes of the batch in one row, a gap behind each document.
                lengths = np.array([max(0, len(x) - part + 1) for x in own], dtype=np.int64)
                starts = np.concatenate([[0], np.cumsum(lengths + 1)])
                hashes = np.zeros(starts[-1], dtype=np.uint64)
                for k, x in enumerate(own):
                    if lengths[k]:
                        hashes[starts[k] : starts[k] + lengths[k]] = rolling(x, part)
                for size in (s for s in windows_of if min(shingle, s) == part):
                    met = _passes(known, hashes, size)
                    doc = np.searchsorted(starts, met, side="right") - 1
                    real = met - starts[doc] < lengths[doc]
                    met, doc = met[real], doc[real]
                    order = np.lexsort((hashes[met], doc))
                    d, h = doc[order], hashes[met][order]
                    once = h[np.r_[True, (d[1:] != d[:-1]) | (h[1:] != h[:-1])]] if len(h) else h
                    counts.append((size, *np.unique(once, return_counts=True)))
                    for start, end in runs_of(met, size - part + 1):
                        k = int(np.searchsorted(starts, start, side="right")) - 1
                        sizes.append(size)
                        at.append(k)
                        found.append(texts[k][start - starts[k] : end - starts[k] + part - 1])
            n = len(sizes)
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.list_(pa.string()))], names=schema.names)
            for size, h, count in counts:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), size, dtype=np.int32)), pa.array(h.view(np.int64)), pa.array(count.astype(np.int64)), pa.nulls(len(h), batch.column(0).type), pa.nulls(len(h), pa.list_(pa.string()))], names=schema.names)

    return docs.select(doc_id, text_col).mapInArrow(run, schema)


def _run_shingles(runs: DataFrame, shingle: int) -> DataFrame:
    """Every shingle of a run with the words around it: size, doc, h, back (words before it), words."""
    names = ["size", "doc", "h", "back", "words"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = WordIds()
        for batch in batches:
            rows = []
            for size, doc, words in zip(batch["size"], batch["doc"], batch["words"], strict=True):
                words, part = list(words), min(shingle, int(size))
                for pos, h in enumerate(rolling(ids(words), part).view(np.int64).tolist()):
                    low = max(0, pos + part - size)
                    rows.append((size, doc, h, pos - low, words[low : pos + size]))
                    if len(rows) >= 20_000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
            yield pd.DataFrame(rows, columns=names)

    schema = T.StructType([runs.schema["size"], runs.schema["doc"], T.StructField("h", T.LongType()), T.StructField("back", T.IntegerType()), runs.schema["words"]])
    return runs.select("size", "doc", "words").mapInPandas(run, schema)


def leaked(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, item_id of the documents that contain ``window`` consecutive words of an item (all of it if shorter)."""
    windows = checkpoint(item_windows(items, item_id, text_col, window, shingle))
    sizes, bits = _bitmap(windows)
    found = checkpoint(_scan(docs, doc_id, text_col, sizes, bits, shingle))
    frequency = found.filter("n IS NOT NULL").groupBy("size", "h").agg(F.sum("n").alias("n"))
    # The rarest shingle of each window; one that no document holds rules the window out.
    shingles = windows.select("item", "size", "words", F.posexplode("hashes").alias("offset", "h"))
    counted = shingles.join(frequency, ["size", "h"], "left").groupBy("item", "size", "words").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "offset")).alias("p"))
    prefixes = counted.filter("p.n > 0").select("item", "size", F.col("words").alias("wanted"), "p.h", "p.offset")
    runs = _run_shingles(found.filter("n IS NULL").select("size", "doc", "words"), shingle)
    start = F.col("back") - F.col("offset")
    held = runs.join(prefixes, ["size", "h"]).filter((start >= 0) & (start + F.col("size") <= F.size("words"))).filter(F.slice("words", start + 1, F.col("size")) == F.col("wanted"))
    return held.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id)).distinct()
