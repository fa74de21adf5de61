"""Near-duplicate records: exact set-similarity self-join over word n-grams.

1. Signature scan: the digest of every record's n-gram set, and two count sketches of fixed size, of n-grams and of words.
   Records with equal digests are copies; one representative per class goes on.
2. Prefix scan: each representative's n-grams are ordered rarest first (``Order``). A pair at or above the threshold
   shares an n-gram within both prefixes, so only prefix n-grams are joined. N-grams that the sketch proves unique are
   left out, as they meet nothing. The join applies the length filter and the positional filter.
3. A pair at or above the threshold that needs ``o`` common n-grams shares at least ``least`` of them within prefixes
   that are longer by ``least - 1``. Joined rows are counted per pair, and pairs with fewer are dropped; this also makes
   the candidates distinct, so that a pair is verified once.
4. The sets of what is left are read again; a suffix filter (sizes of the parts of both sets between fixed pivots) drops
   pairs whose parts differ too much, the rest is verified exactly.

Nothing unbounded is collected or broadcast: the sketches and the bitmap of surviving ids have at most a fixed size (an
overfull bitmap only lets more sets into the shuffle of the verification), the ids of copies are broadcast only after a
count. A prefix n-gram is hot by the exact number of its prefix rows; its records, ordered by set size, are spread over
pairs of blocks of compatible sizes. How full the sketches are changes the order only, never the rows that are copied.

Defined results: null texts and texts with fewer words than ``n`` have no set and no partner; a record is no partner of
itself; repeated ids count as one record; equal sets are copies with similarity 1; case, punctuation and spacing do not
matter; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.session import BROADCAST_ROWS, checkpoint
from cairn.text import WordIds, rolling, words

MIN_BUCKETS, MAX_BUCKETS, PART = 1 << 18, 1 << 24, 1 << 17  # counters of the n-gram sketch
WORD_BUCKETS = 1 << 20
FAN = 64  # groups of tasks whose sketches are added in the first round
SPLIT = 512  # records of one n-gram that may meet in one group
LEAST = 4  # n-grams that a candidate pair must share within the prefixes
MIN_ID_BITS, MAX_ID_BITS = 1 << 20, 1 << 27
BLOCK = 256  # members of a class, on average, that are paired as one row


def ngrams(text: str | None, n: int, ids: WordIds) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of a text."""
    return np.unique(rolling(ids(words(text)), n))


def prefix_length(size: int, threshold: float) -> int:
    return size - math.ceil(threshold * size - 1e-9) + 1


def needed(a: int, b: int, threshold: float) -> int:
    """Common n-grams that sets of these sizes need."""
    return math.ceil(threshold / (1 + threshold) * (a + b) - 1e-9)


PIVOTS = np.linspace(0, 2**64 - 1, 18)[1:-1].astype(np.uint64)


def suffix_bound(x: np.ndarray, y: np.ndarray) -> int:
    """Lower bound of the symmetric difference of two sorted sets, from the sizes of their parts between the pivots."""
    a, b = np.diff(np.searchsorted(x, PIVOTS), prepend=0, append=len(x)), np.diff(np.searchsorted(y, PIVOTS), prepend=0, append=len(y))
    return int(np.abs(a - b).sum()) if len(a) == len(b) else 0


def _signatures(df: DataFrame, n: int, buckets: int) -> DataFrame:
    """id and digest of every record with a set, and the parts of each task's sketch (n-gram counts, then word counts)."""
    total = buckets + WORD_BUCKETS
    part = min(PART, total)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sketch, some = WordIds(), np.zeros(total, dtype=np.uint32), False
        names = ["id", "digest", "part", "slot", "counts"]
        for batch in batches:
            keys, digests = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = ids(words(text))
                grams = np.unique(rolling(tokens, n))
                if not len(grams) or key is None:
                    continue
                some = True
                np.add.at(sketch, (grams & np.uint64(buckets - 1)).astype(np.int64), 1)
                np.add.at(sketch, buckets + (tokens & np.uint64(WORD_BUCKETS - 1)).astype(np.int64), 1)
                keys.append(key)
                digests.append(xxhash.xxh3_128_digest(grams.tobytes()))
            k = len(keys)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(digests, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names)
        slot = TaskContext.get().partitionId() % FAN
        for at in range(-(-total // part)) if some else ():  # one part at a time, so that a task holds no second sketch
            blob = zlib.compress(sketch[at * part : (at + 1) * part].tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([at], pa.int32()), pa.array([slot], pa.int32()), pa.array([blob], pa.binary())], names=names)

    return df.mapInArrow(scan, "id long, digest binary, part int, slot int, counts binary")


def folded(parts: DataFrame, keys: list[str], dtype: type, size: int, add: Callable) -> DataFrame:
    """One blob per key: a task streams the blobs of sorted keys and holds one running array."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = None, np.zeros(size, dtype=dtype)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([k], pa.int32()) for k in own), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=[*keys, "counts"])

        for batch in batches:
            for *key, blob in zip(*(batch.column(k).to_pylist() for k in range(len(keys))), batch.column(len(keys)), strict=True):
                if own is not None and key != own:
                    yield done()
                    total = np.zeros(size, dtype=dtype)
                own, more = key, np.frombuffer(zlib.decompress(blob.as_py()), dtype=dtype)
                total[: len(more)] = add(total[: len(more)], more)
        if own is not None:
            yield done()

    return parts.select(*keys, "counts").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(fold, ", ".join(f"{k} int" for k in keys) + ", counts binary")


def _capped_sum(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.minimum(x.astype(np.uint64) + y, 2**32 - 1).astype(np.uint32)


class Order:
    """Rare-first order of n-grams from two fixed-size sketches, the same for all records.

    First by how far the n-gram's count stands out of the mean load of its sketch, then by the frequency of its words,
    then by hash. While the load is small the first part is the count itself; on a corpus far larger than the sketch only
    n-grams that are hot stand out, and the words, whose shares do not change with the size of the corpus, order the rest.
    """

    def __init__(self, counts: np.ndarray, buckets: int):
        grams, self.mask, self.words = counts[:buckets], np.uint64(buckets - 1), np.round(8 * np.log2(1.0 + counts[buckets:])).astype(np.int32)
        load = float(grams.sum(dtype=np.float64)) / buckets
        self.noise = math.ceil(load + 3 * math.sqrt(load)) if load > 0.5 else 1
        self.grams = np.minimum(grams, 65_535).astype(np.uint16)

    def __call__(self, tokens: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams of a record in order, sketch counts)."""
        grams, first = np.unique(rolling(tokens, n), return_index=True)
        if not len(grams):
            return grams, grams
        words_cost = self.words[(tokens & np.uint64(WORD_BUCKETS - 1)).astype(np.int64)]
        rarity = sum(words_cost[k : len(words_cost) - n + 1 + k] for k in range(n))[first]
        freq = self.grams[(grams & self.mask).astype(np.int64)]
        at = np.lexsort((grams, rarity, np.maximum(freq, self.noise)))
        return grams[at], freq[at]


def _order(signatures: DataFrame, buckets: int) -> Order:
    """Sum of the tasks' sketches, in two rounds, so that no task reads the parts of all others."""
    total = buckets + WORD_BUCKETS
    part = min(PART, total)
    rows = folded(folded(signatures.filter("part IS NOT NULL"), ["part", "slot"], np.uint32, part, _capped_sum), ["part"], np.uint32, part, _capped_sum)
    counts = np.zeros(total, dtype=np.uint32)
    for row in rows.collect():  # total / part rows, whatever the input
        got = np.frombuffer(zlib.decompress(row.counts), dtype=np.uint32)[: total - row.part * part]
        counts[row.part * part : row.part * part + len(got)] = got
    return Order(counts, buckets)


def _prefixes(df: DataFrame, n: int, threshold: float, least: int, order: Order) -> DataFrame:
    """key, id, place (set size and position) of the prefix n-grams that are not proven unique."""
    shared = df.sparkSession.sparkContext.broadcast(order)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ranked = WordIds(), shared.value
        for batch in batches:
            owners, places, keys = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grams, freq = ranked(ids(words(text)), n)
                if not len(grams) or key is None:
                    continue
                kept = np.flatnonzero(freq[: prefix_length(len(grams), threshold) + least - 1] > 1)
                owners.append(np.full(len(kept), key, dtype=np.int64))
                places.append(kept + (len(grams) << 32))
                keys.append(grams[kept].view(np.int64))
            flat = lambda parts: pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([flat(keys), flat(owners), flat(places)], names=["key", "id", "place"])

    return df.mapInArrow(scan, "key long, id long, place long")


def _groups(batches: Iterator[pa.RecordBatch], split: int | None) -> Iterator[tuple[list[np.ndarray], list[np.ndarray], np.ndarray]]:
    """(rows of whole groups of equal keys, rows of groups of more than ``split``, their block) of rows sorted by key.

    At most ``split`` rows of an open group are held back; a larger one is passed on as it comes, in blocks of ``split``.
    """
    none = [np.empty(0, np.int64)] * 3
    held, open_key, passed = none, None, 0
    for batch in batches_with_end(batches):
        part = held if batch is None else [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns, strict=True)]
        if not len(part[0]):
            continue
        key = part[0]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(key)]))
        before = passed if passed and key[0] == open_key else 0
        counts = np.diff(np.r_[starts, len(key)])
        counts[0] += before
        ordinal = np.arange(len(key)) - starts[group]
        ordinal[group == 0] += before
        large = counts > split if split is not None else np.zeros(len(counts), dtype=bool)
        last_open = batch is not None
        wait = (group == len(starts) - 1) & (not large[-1]) if last_open else np.zeros(len(key), dtype=bool)
        hot = large[group]
        held, open_key, passed = ([p[wait] for p in part], key[-1], int(counts[-1]) if large[-1] else 0) if last_open else (none, None, 0)
        small = ~hot & ~wait
        yield [p[small] for p in part], [p[hot] for p in part], ordinal[hot] // (split or 1)


def _met_pairs(key: np.ndarray, owner: np.ndarray, place: np.ndarray, threshold: float, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows with equal keys (sorted) that pass the length and positional filters: larger set, smaller, least."""
    side, size, position = place >> 60, (place >> 32) & 0xFFFFFFF, place & 0xFFFFFFFF
    rest = size - position
    found, at, step = [], np.arange(len(key)), 0
    while True:
        step += 1
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
        if not len(at):
            break
        x, y = at, at + step
        swap = (size[x] < size[y]) | ((size[x] == size[y]) & (owner[x] < owner[y]))
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        common = np.ceil(threshold / (1 + threshold) * (size[x] + size[y]) - 1e-9).astype(np.int64)
        bound = np.minimum(least, common)
        ok = ((side[x] == 0) | (side[x] != side[y])) & (owner[x] != owner[y]) & (size[y] >= np.ceil(threshold * size[x] - 1e-9)) & (np.minimum(rest[x], rest[y]) + bound - 1 >= common)
        found.append((owner[x[ok]], owner[y[ok]], bound[ok]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate([f[k] for f in found]) for k in range(3))  # type: ignore[return-value]


def _candidates(rows: DataFrame, threshold: float, least: int, split: int) -> DataFrame:
    """Distinct pairs (a the larger set) that share enough n-grams within their prefixes.

    The rows are shuffled once. Groups of more than ``split`` rows are counted there, exactly; ordered by set size they
    are cut into blocks of ``split``, and only blocks whose sizes satisfy the length filter meet, each pair in a group of
    its own.
    """

    def meet(split: int | None) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for small, _, _ in _groups(batches, split):
                a, b, bound = _met_pairs(*small, threshold, least)
                for k in range(0, len(a), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 100_000]) for c in (a, b, bound.astype(np.int32))], names=["a", "b", "bound"])

        return run

    def hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (key, owner, place), block in _groups(batches, split):
            if len(key):
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(owner), pa.array(place), pa.array(block)], names=["key", "id", "place", "block"])

    pair = "a long, b long, bound int"
    sorted_rows = rows.repartition("key").sortWithinPartitions("key", "place", "id")
    large = sorted_rows.mapInArrow(hot, "key long, id long, place long, block long")
    size = F.shiftright("place", 32)
    span = large.groupBy("key", "block").agg(F.min(size).alias("low"), F.max(size).alias("high"))
    x = span.select("key", F.col("block").alias("x"), "high")
    y = span.select("key", F.col("block").alias("y"), "low")
    near = x.join(y, "key").filter((F.col("x") <= F.col("y")) & (F.col("high") >= F.ceil(threshold * F.col("low") - 1e-9)))
    sides = F.when(F.col("x") == F.col("y"), F.array(F.struct(F.col("x").alias("block"), F.lit(0).alias("side")))).otherwise(F.array(F.struct(F.col("x").alias("block"), F.lit(1).alias("side")), F.struct(F.col("y").alias("block"), F.lit(2).alias("side"))))
    near = near.select("key", F.xxhash64("key", "x", "y").alias("meeting"), F.explode(sides).alias("s")).select("key", "meeting", "s.*")
    spread = large.join(near, ["key", "block"]).select(F.col("meeting").alias("key"), "id", (F.col("place") + F.shiftleft(F.col("side").cast("long"), 60)).alias("place"))
    met = sorted_rows.mapInArrow(meet(split), pair).unionByName(spread.repartition("key").sortWithinPartitions("key").mapInArrow(meet(None), pair))
    return met.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("bound").alias("least")).filter("n >= least").select("a", "b")


def batches_with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def id_bits(pairs: DataFrame, size: int) -> np.ndarray:
    """A bitmap of ``size`` bits that holds all ids of the pairs (and some others), combined in two rounds."""
    part = min(PART, size // 8)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size // 8, dtype=np.uint8)
        for batch in batches:
            for column in batch.columns:
                at = column.to_numpy(zero_copy_only=False).astype(np.int64) % size
                np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        slot = TaskContext.get().partitionId() % FAN
        for at in range(len(bits) // part):
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([slot], pa.int32()), pa.array([zlib.compress(bits[at * part : (at + 1) * part].tobytes(), 1)], pa.binary())], names=["part", "slot", "counts"])

    parts = pairs.mapInArrow(scan, "part int, slot int, counts binary")
    rows = folded(folded(parts, ["part", "slot"], np.uint8, part, np.bitwise_or), ["part"], np.uint8, part, np.bitwise_or)
    total = np.zeros(size // 8, dtype=np.uint8)
    for row in rows.collect():
        total[row.part * part : (row.part + 1) * part] = np.frombuffer(zlib.decompress(row.counts), dtype=np.uint8)
    return total


def _sets(df: DataFrame, n: int, bits: np.ndarray) -> DataFrame:
    """id and n-gram set of the records whose id is in the bitmap."""
    shared = df.sparkSession.sparkContext.broadcast(bits)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, known = WordIds(), shared.value
        for batch in batches:
            keys, blobs = [], []
            at = batch.column(0).to_numpy(zero_copy_only=False)
            for k in range(len(at)):
                i = int(at[k]) % (8 * len(known))
                if known[i >> 3] >> (i & 7) & 1:
                    keys.append(int(at[k]))
                    blobs.append(ngrams(batch.column(1)[k].as_py(), n, ids).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], names=["id", "grams"])

    return df.mapInArrow(scan, "id long, grams binary")


def _verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("id").alias("b"), F.col("grams").alias("gb")), "b")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, ga, gb = (c.to_pylist() for c in batch.columns)
            out = []
            for k in range(len(a)):
                x, y = np.frombuffer(ga[k], dtype=np.uint64), np.frombuffer(gb[k], dtype=np.uint64)
                if suffix_bound(x, y) > len(x) + len(y) - 2 * needed(len(x), len(y), threshold):
                    continue
                common = len(np.intersect1d(x, y, assume_unique=True))
                if common >= threshold * (len(x) + len(y) - common) - 1e-9:
                    out.append((a[k], b[k], common / (len(x) + len(y) - common)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.float64())], names=["a", "b", "similarity"])

    return both.select("a", "b", "ga", "gb").mapInArrow(test, "a long, b long, similarity double").dropDuplicates(["a", "b"])


def power_of_two(n: float, low: int, high: int) -> int:
    """The least power of two that is at least ``n``, within bounds."""
    return min(max(1 << max(0, math.ceil(math.log2(max(n, 1)))), low), high)


def similar_classes(df: DataFrame, id_col: str, text_col: str, n: int = 5, threshold: float = 0.8, least: int = LEAST, split: int = SPLIT, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs of class representatives with their similarity, membership id -> representative with the class size).

    The sketch has about one counter for eight bytes of text, at most ``MAX_BUCKETS``, or ``buckets`` counters.
    """
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    if buckets is None:
        buckets = power_of_two((texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / 8, MIN_BUCKETS, MAX_BUCKETS)
    signatures = checkpoint(_signatures(texts, n, buckets))
    order = _order(signatures, buckets)
    records = signatures.filter("digest IS NOT NULL").select("id", "digest")
    classes = records.groupBy("digest").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("copies"))
    members = records.join(classes, "digest").select("id", "rep", "copies").distinct()
    copies = members.filter("id <> rep").select("id")
    if copies.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        copies = F.broadcast(copies)
    singles = texts.join(copies, "id", "left_anti").select("id", "text")
    close = checkpoint(_candidates(_prefixes(singles, n, threshold, least, order), threshold, least, split))
    bits = power_of_two(16 * close.count(), MIN_ID_BITS, MAX_ID_BITS)
    return _verify(close, _sets(texts, n, id_bits(close, bits)), threshold), members


def _block_pairs(pairs: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """i, j of all members of the classes a and b (``ca``, ``cb`` members each); where both are the same class, each pair once.

    Joins meet blocks of members as one row, so they stay small however many pairs come out, and large classes are spread.
    """
    blocks = lambda copies: F.ceil(copies / size).cast("int")
    filled = members.withColumn("block", F.pmod(F.xxhash64("id"), blocks(F.col("copies"))).cast("int")).groupBy("rep", "block").agg(F.collect_list("id").alias("ids"))
    x = filled.select(F.col("rep").alias("a"), F.col("block").alias("x"), F.col("ids").alias("i"))
    y = filled.select(F.col("rep").alias("b"), F.col("block").alias("y"), F.col("ids").alias("j"))
    numbered = pairs.select("a", "b", "cb", F.explode(F.sequence(F.lit(0), blocks(F.col("ca")) - 1)).alias("x"))
    from_block = F.when(F.col("a") == F.col("b"), F.col("x")).otherwise(0)
    numbered = numbered.select("a", "b", "x", F.explode(F.sequence(from_block, blocks(F.col("cb")) - 1)).alias("y"))
    met = numbered.join(x, ["a", "x"]).join(y, ["b", "y"])
    one = ((F.col("a") == F.col("b")) & (F.col("x") == F.col("y"))).alias("one")
    met = met.select(one, F.explode("i").alias("i"), "j").select("one", "i", F.explode("j").alias("j"))
    return met.filter("NOT one OR i < j").select("i", "j")


def near_duplicate_pairs(df: DataFrame, id_col: str, text_col: str, n: int = 5, threshold: float = 0.8, block: int = BLOCK) -> DataFrame:
    """a_id < b_id of all similar records, copies included."""
    links, members = similar_classes(df, id_col, text_col, n, threshold)
    members = checkpoint(members)
    links = checkpoint(links)
    sized = members.filter("id = rep").select("rep", "copies")
    x = sized.select(F.col("rep").alias("a"), F.col("copies").alias("ca"))
    y = sized.select(F.col("rep").alias("b"), F.col("copies").alias("cb"))
    wide = links.join(x, "a").join(y, "b").select("a", "b", "ca", "cb", (F.col("ca") * F.col("cb") == 1).alias("single"))
    same = sized.filter("copies > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.col("copies").alias("ca"), F.col("copies").alias("cb"))
    whole = _block_pairs(wide.filter("NOT single").select("a", "b", "ca", "cb").unionByName(same), members, block)
    pairs = wide.filter("single").select(F.col("a").alias("i"), F.col("b").alias("j")).unionByName(whole)
    return pairs.select(F.least("i", "j").alias("a_id"), F.greatest("i", "j").alias("b_id"))


def components(edges: DataFrame) -> DataFrame:
    """id, group (the least id) of every node of the edges a, b: large-star and small-star rounds until nothing changes.

    A round is two aggregations and joins over the edges, cut by a checkpoint; hot nodes are combined before the shuffle.
    """
    now, mark = checkpoint(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = checkpoint(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("u").alias("id"), F.col("v").alias("group")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("group")).distinct())


def near_duplicate_groups(df: DataFrame, id_col: str, text_col: str, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """id, group_id, class_id, copies, n_links of every record with a set.

    ``group_id`` is the least class id that chains of similar records lead to, ``class_id`` the representative of the
    record's copies, ``n_links`` the similar classes of its class.
    """
    links, members = similar_classes(df, id_col, text_col, n, threshold)
    links, members = checkpoint(links.select("a", "b")), checkpoint(members)
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    groups = components(links).withColumnRenamed("id", "rep")
    out = members.join(groups, "rep", "left").join(degree, "rep", "left")
    return out.select("id", F.coalesce("group", "rep").alias("group_id"), F.col("rep").alias("class_id"), "copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
