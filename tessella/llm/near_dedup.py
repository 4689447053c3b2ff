"""MinHash near-duplicate detection with banded candidates and odd sketches.

A text's set is its distinct word shingles. Rows with equal sets are one node, named by
their smallest id. Each node has MinHash samples; bands of them put nodes that may be
similar into buckets. Sets that link have sizes in the same or in neighbouring classes
of a geometric scale, so a bucket holds the sets of one class and the next.

Two bitmaps discard candidates. An odd sketch folds all samples: the population count of
two sketches' exclusive or estimates the similarity, and pairs that are far below the
threshold go. The same of the whole set never has more bits than the sets' difference
has members, so it discards without error whatever differs in too many. What is left is
confirmed on the full shingle sets.

No bucket is paired out: :mod:`tessella.llm.clusters` finds the links between members.

Defined cases: texts without words (null or empty) have an empty set and link with
nothing; a text with fewer words than a shingle has its whole sequence as one shingle;
rows with a null id are kept and are linked with nothing; rows that repeat an id are
one vertex, which has the links of all their texts; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.clusters import components_of, members_of
from tessella.llm.common import column_buffers, cut, slices
from tessella.llm.textscan import U, lowered, mix, run_hashes, word_hashes, words_of

SLICE_BYTES = 1 << 20
ROWS_PER_BAND = 8
#: Share of links at the threshold that banding and sketches may miss.
MISS = 1e-6
#: 64-bit words of the sample's and of the whole set's bitmap.
SKETCH_WORDS, SET_WORDS = 8, 16
#: Ids up to which the rows wanted for a comparison are picked by a broadcast (of 8 bytes an id), and not by a shuffle.
BROADCAST_IDS = 500_000

BITMAPS = [*(f"s{w}" for w in range(SKETCH_WORDS)), *(f"p{w}" for w in range(SET_WORDS))]
SIGNED = "doc_id long, n_shingles long, k0 long, k1 long, bands array<long>, " + ", ".join(f"{b} long" for b in BITMAPS)


def bands_for(threshold: float, rows: int = ROWS_PER_BAND, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))


def sketch_limit(threshold: float, samples: int, bits: int = 64 * SKETCH_WORDS, sigmas: float = 5.0) -> int:
    """The largest population count that a pair at the threshold plausibly has."""
    differ = samples * (1 - threshold) + sigmas * math.sqrt(samples * threshold * (1 - threshold))
    expected = bits / 2 * (1 - (1 - 2 / bits) ** (2 * differ))
    return math.ceil(expected + sigmas * math.sqrt(bits) / 4)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of all shingles (with repeats), and their count before each row."""
    data = lowered(data)
    starts, ends, before = words_of(data, offsets)
    hashes = word_hashes(data, starts, ends)
    count = np.diff(before)
    whole = (count > 0) & (count < words)
    per_row = np.where(whole, 1, np.maximum(count - words + 1, 0))
    bounds = np.append(0, np.cumsum(per_row))
    row = np.repeat(np.arange(len(count)), per_row)
    at = before[row] + np.arange(bounds[-1]) - bounds[row]
    out = np.zeros(bounds[-1], U)
    full = ~whole[row]
    if full.any():
        out[full] = run_hashes(hashes, words)[at[full]]
    for r in np.flatnonzero(whole):
        out[bounds[r]] = run_hashes(hashes[before[r] : before[r + 1]], int(count[r]))[0] ^ U(count[r])
    return out, bounds


def distinct_sets(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row, and their bounds."""
    sets = [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    return np.concatenate(sets) if sets else hashes, np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int64)


def set_keys(sets: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
    """A 128-bit key of each row's set, in two columns; null for an empty one."""
    size = np.diff(bounds)
    full = np.flatnonzero(size)
    out = []
    for salt in (U(0x243F6A8885A308D3), U(0x13198A2E03707344)):
        lane = np.zeros(len(size), U)
        if len(full):
            lane[full] = np.add.reduceat(mix(sets ^ salt), bounds[full])
        out.append(pa.array(lane.view(np.int64), mask=size == 0))
    return out


def parities(hashes: np.ndarray, row: np.ndarray, rows: int, words: int) -> np.ndarray:
    """Each row's bitmap of 64-bit words: a bit is set if an odd number of the row's hashes fall on it."""
    bits = 64 * words
    counts = np.bincount(row * bits + (hashes % U(bits)).astype(np.int64), minlength=rows * bits)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64).reshape(rows, words)


def _sign(words: int, bands: int, rows: int, threshold: float):
    # sets hold mixed hashes, so their products with odd numbers are samples of permutations
    salts = mix(np.arange(1, bands * rows + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_buffers(batch.column(1))
            for i, j in slices(offsets, SLICE_BYTES):
                hashes, bounds = shingle_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
                sets, bounds = distinct_sets(hashes, bounds)
                size = np.diff(bounds)
                full = np.flatnonzero(size)
                lowest = np.zeros((len(salts), j - i), U)
                product = np.empty_like(sets)
                for k, salt in enumerate(salts if len(full) else ()):
                    np.multiply(sets, salt, out=product)
                    lowest[k, full] = np.minimum.reduceat(product, bounds[full])
                row_of_sample = np.broadcast_to(np.arange(j - i), lowest.shape).reshape(-1)
                bitmaps = np.concatenate([parities(mix(lowest + salts[:, None]).reshape(-1), row_of_sample, j - i, SKETCH_WORDS), parities(mix(sets), np.repeat(np.arange(j - i), size), j - i, SET_WORDS)], axis=1)
                # sizes in the ratio of the threshold are at most one class apart
                size_class = np.floor(np.log(np.maximum(size, 1)) / (-math.log(threshold) * (1 + 1e-9))).astype(U)
                keys = np.zeros((j - i, 2 * bands), U)
                for b in range(bands):
                    h = np.full(j - i, b + 1, U)
                    for r in range(rows):
                        h = mix(h ^ lowest[b * rows + r])
                    keys[:, 2 * b], keys[:, 2 * b + 1] = mix(h + size_class), mix(h + size_class + U(1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i + 1) * 2 * bands, 2 * bands, dtype=np.int32)), pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(size), *set_keys(sets, bounds), lists, *(pa.array(b.copy()) for b in bitmaps.T)],
                    [x.split()[0] for x in SIGNED.split(", ")],
                )

    return run


def _confirm(words: int, threshold_percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, np.ndarray] = {}
        held = [0]

        def full_set(text: str) -> np.ndarray:
            """The set of a text; hot pivots come again and again."""
            if text not in kept:
                data = np.frombuffer(text.encode(), np.uint8)
                own, _ = distinct_sets(*shingle_hashes(data, np.array([0, len(data)]), words))
                held[0] += len(own) + len(text) // 8
                if held[0] > 4 << 20:  # hashes held
                    kept.clear()
                    held[0] = len(own) + len(text) // 8
                kept[text] = own
            return kept[text]

        for batch in batches:
            good = []
            for k, (a, b) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = full_set(a.as_py()), full_set(b.as_py())
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both and 100 * both >= threshold_percent * (len(x) + len(y) - both):
                    good.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(good, pa.int64())) for i in (0, 1)], ["a", "b"])

    return run


def differing(x: str, y: str, names: list[str]) -> Column:
    """The bits that differ in two nodes' bitmaps (columns with these prefixes)."""
    return reduce(lambda a, b: a + b, [F.bit_count(F.col(f"{x}{n}").bitwiseXOR(F.col(f"{y}{n}"))) for n in names])


def sets_may_link(x: str, y: str, threshold_percent: int) -> Column:
    """Whether sizes and the whole sets' bitmaps allow a link; a pair that links is never refused."""
    a, b = F.col(f"{x}n"), F.col(f"{y}n")
    sizes = 100 * F.least(a, b) >= threshold_percent * F.greatest(a, b)
    # at the threshold the sets' difference has (a + b) * (100 - t) / (100 + t) members
    return sizes & (differing(x, y, BITMAPS[SKETCH_WORDS:]) * (100 + threshold_percent) <= (a + b) * (100 - threshold_percent))


def _may_link(x: str, y: str, limit: int, threshold_percent: int) -> Column:
    """Whether sizes and both bitmaps of two nodes allow a link."""
    return sets_may_link(x, y, threshold_percent) & (differing(x, y, BITMAPS[:SKETCH_WORDS]) <= limit)


def confirming(rows: DataFrame, words: int, threshold_percent: int) -> Callable[[DataFrame], DataFrame]:
    """A function that keeps those pairs (a, b) of ids of ``rows`` (doc_id, text) that the full sets confirm."""
    texts = rows.where("doc_id IS NOT NULL AND text IS NOT NULL")

    def linked(pairs: DataFrame) -> DataFrame:
        if pairs.count() <= BROADCAST_IDS:
            # each pair's b brings its text to a, so texts are shuffled once
            one = texts.withColumnRenamed("doc_id", "b").join(F.broadcast(pairs), "b").withColumnRenamed("text", "b_text")
            firsts = F.broadcast(pairs.select("a").distinct())
            two = one.join(texts.withColumnRenamed("doc_id", "a").join(firsts, "a").withColumnRenamed("text", "a_text"), "a")
        else:
            wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
            own = texts.join(wanted, "doc_id")
            one = pairs.join(own.select(F.col("doc_id").alias("b"), F.col("text").alias("b_text")), "b")
            two = one.join(own.select(F.col("doc_id").alias("a"), F.col("text").alias("a_text")), "a")
        return cut(two.select("a", "b", "a_text", "b_text").mapInArrow(_confirm(words, threshold_percent), "a long, b long").distinct())

    return linked


def representatives(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The smallest id (node) of each set (k0, k1), and the rows of those ids; only ids and keys are joined, not the rows' columns."""
    reps = cut(keyed.groupBy("k0", "k1").agg(F.min("doc_id").alias("node")))
    copies = cut(keyed.select("doc_id", "k0", "k1").join(reps, ["k0", "k1"]).where("doc_id <> node").select("doc_id", "k0").distinct())
    copies = F.broadcast(copies) if copies.count() <= BROADCAST_IDS else copies
    return reps, keyed.join(copies, ["doc_id", "k0"], "left_anti").withColumnRenamed("doc_id", "node")


def near_duplicates(docs: DataFrame, words: int = 5, threshold_percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest id that links reach), kept (id equals component_id).

    Rows link if the intersection of their shingle sets is at least ``threshold_percent``
    hundredths of the union. Shingles are compared by 64-bit hashes, nodes have 128-bit keys.
    """
    bands = bands_for(threshold_percent / 100)
    limit = sketch_limit(threshold_percent / 100, bands * ROWS_PER_BAND)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = cut(rows.mapInArrow(_sign(words, bands, ROWS_PER_BAND, threshold_percent / 100), SIGNED))
    keyed = signed.where("k0 IS NOT NULL AND doc_id IS NOT NULL")
    reps, own_rows = representatives(keyed)
    nodes = cut(own_rows.select("node", F.col("n_shingles").alias("n"), "bands", *BITMAPS))
    members = cut(members_of(nodes.select(F.explode("bands").alias("bucket"), "node")))

    # the texts of one id are one vertex
    own = keyed.join(reps, ["k0", "k1"]).select("doc_id", "node")
    several = own.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a < last")
    same = own.join(several, "doc_id").where("a < node").select("a", F.col("node").alias("b")).distinct()
    confirmed = confirming(rows, words, threshold_percent)
    parts = components_of(members, nodes.drop("bands"), same, lambda x, y: _may_link(x, y, limit, threshold_percent), confirmed)
    labels = reps.join(parts, "node", "left").select("k0", "k1", F.coalesce("component", "node").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("k0")).alias("k0"), "k1").join(labels, ["k0", "k1"], "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, words: int = 5, threshold_percent: int = 80) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and others) but for those that are near copies of a smaller doc_id."""
    judged = near_duplicates(docs, words, threshold_percent).where("NOT kept").select("doc_id").distinct()
    return docs.join(judged, "doc_id", "left_anti")


def components_by_brute_force(rows: list[tuple[int, str | None]], words: int, threshold_percent: int) -> dict[int, tuple[int, int]]:
    """doc_id to (set size, component_id) of a small list of rows, over all pairs: for tests."""
    sets = {}
    for d, text in rows:
        w = [x.decode("utf-8", "surrogateescape") for x in (text or "").encode().lower().split()]
        sets[d] = {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
    parent = {d: d for d in sets}

    def root(d: int) -> int:
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= threshold_percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= threshold_percent * (len(x) + len(y) - both):
                    lo, hi = sorted((root(a), root(b)))
                    parent[hi] = lo
    return {d: (len(sets[d]), root(d)) for d in ids}
