"""Exact set similarity join by partitioning the universe of shingles.

Sets that link have sizes in the same or in neighbouring classes of a geometric scale. Two
sets of a class and the one below differ in H shingles at most, which follows from the
threshold and the class's largest size. The shingles are hashed to ceil((H + 1) / 2)
blocks of two segments each, so by the pigeonhole principle some block differs in one
shingle at most: one of its segments is the same in both sets, and the other differs in
one shingle at most.

A set is indexed by its part in each segment (its exact keys). What a key costs is how
many sets hold it: where more than ``most_shared`` do (an empty part, a common passage), the
allocation skips that segment and asks more of the block's other one, which is indexed by
its part and by the part without each one of its shingles (its one-deletion keys), each
together with the skipped part. Sets that share a skipped part both skip it, and so meet
under the other segment's deletion keys; where the other part is what they share, its
exact key is met, or is skipped by both. Parts that differ in one shingle are the smaller
one and the larger without that shingle, so a key that no set has as its whole part links
nothing and goes. So no link is lost, whatever the bound, which moves cost only.

Sets under one key are compared by :mod:`tessella.llm.clusters`, first by bitmaps that
never refuse a link, then by the full sets.

Defined cases: texts without words (null or empty) have an empty set and link with
nothing; a text with fewer words than a shingle has its whole sequence as one shingle; rows
with a null id stay and are linked with nothing; rows that repeat an id are one vertex,
which has the links of all their texts; columns other than id and text are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.clusters import components_of, members_of
from tessella.llm.common import column_buffers, cut, slices
from tessella.llm.near_dedup import BITMAPS, BROADCAST_IDS, SET_WORDS, SKETCH_WORDS, confirming, distinct_sets, parities, representatives, set_keys, sets_may_link, shingle_hashes
from tessella.llm.textscan import U, mix

SLICE_BYTES = 1 << 20
#: Sets that share a key beyond which its segment is skipped, and the other of its block is indexed with deletions.
MOST_SHARED = 256
SET_BITMAP = BITMAPS[SKETCH_WORDS:]
SIGNED = "doc_id long, n_shingles long, k0 long, k1 long, keys array<long>, " + ", ".join(f"{b} long" for b in SET_BITMAP)
PART, SEGMENT, DELETED = U(0x452821E638D01377), U(0xBE5466CF34E90C6C), U(0xC0AC29B7C97C50DD)


class Partition:
    """Where the shingles of a set of each size go, for a threshold in hundredths."""

    def __init__(self, threshold_percent: int):
        self.threshold = threshold_percent
        self.step = -math.log(threshold_percent / 100) * (1 + 1e-9) if threshold_percent < 100 else math.inf

    def differing(self, sizes: np.ndarray) -> np.ndarray:
        """The most shingles in which two linked sets differ whose sizes add up to ``sizes``."""
        return sizes * (100 - self.threshold) // (100 + self.threshold)

    def classes(self, size: np.ndarray) -> np.ndarray:
        return np.floor(np.log(np.maximum(size, 1)) / self.step).astype(np.int64)

    def blocks(self, classes: np.ndarray) -> np.ndarray:
        """Blocks under which sets of these classes meet each other and those of the class below."""
        largest = np.exp((classes + 1) * self.step).astype(np.int64) + 1
        return (self.differing(2 * largest) + 2) // 2

    def alone(self, size: np.ndarray) -> np.ndarray:
        """Whether sets of this size link with equal sets only."""
        return self.differing(size + size * 100 // self.threshold) == 0

    def segments(self, sets: np.ndarray, bounds: np.ndarray, above: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each set's own class, or the one above: segments before each row, each shingle's segment, the segments' sums, and their salts.

        A part's hash is the sum of its shingles' hashes, so that one shingle can be taken out.
        """
        size = np.diff(bounds)
        classes = self.classes(size) + above
        count = np.where((size == 0) | self.alone(size), 0, 2 * self.blocks(classes))
        before = np.append(0, np.cumsum(count))
        row = np.repeat(np.arange(len(size)), size)
        row, used = row[count[row] > 0], sets[count[row] > 0]
        salt = mix(classes.astype(U) + SEGMENT)
        place = before[row] + (mix(used ^ salt[row]) % count[row].astype(U)).astype(np.int64)
        sums = np.zeros(before[-1], U)
        np.add.at(sums, place, mix(used ^ PART))
        owner = np.repeat(np.arange(len(size)), count)
        own = mix(salt[owner] + (np.arange(before[-1]) - before[owner]).astype(U))
        return before, place, sums, own


def _lists(values: np.ndarray, owner: np.ndarray, rows: int) -> pa.Array:
    """The values as a list for each row that owns some."""
    order = np.argsort(owner, kind="stable")
    bounds = np.append(0, np.cumsum(np.bincount(owner, minlength=rows)))
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values[order].view(np.int64)))


def _sign(words: int, partition: Partition):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_buffers(batch.column(1))
            for i, j in slices(offsets, SLICE_BYTES):
                hashes, bounds = shingle_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
                sets, bounds = distinct_sets(hashes, bounds)
                size, n = np.diff(bounds), j - i
                keys, owner = [], []
                for above in (0, 1):
                    before, _, sums, own = partition.segments(sets, bounds, above)
                    keys.append(mix(sums ^ own))
                    owner.append(np.repeat(np.arange(n), np.diff(before)))
                bitmaps = parities(mix(sets), np.repeat(np.arange(n), size), n, SET_WORDS)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, n), pa.array(size), *set_keys(sets, bounds), _lists(np.concatenate(keys), np.concatenate(owner), n), *(pa.array(b.copy()) for b in bitmaps.T)],
                    [x.split()[0] for x in SIGNED.split(", ")],
                )

    return run


def _deletions(words: int, partition: Partition):
    """The keys of the segments whose partners are skipped: of parts without one shingle, and of whole parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_buffers(batch.column(1))
            for i, j in slices(offsets, SLICE_BYTES):
                sets, bounds = distinct_sets(*shingle_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words))
                n, size = j - i, np.diff(bounds)
                skipped = np.unique(batch.column(2).slice(i, n).flatten().to_numpy()).view(U)
                wholes, less, owner, less_owner = [], [], [], []
                for above in (0, 1):
                    before, place, sums, own = partition.segments(sets, bounds, above)
                    rows = np.repeat(np.arange(n), np.diff(before))
                    # segments come in blocks of two, so a row's first one is even
                    other = mix(sums ^ own).reshape(-1, 2)[:, ::-1].reshape(-1)
                    asked = np.isin(other, skipped)
                    key = lambda at, part: mix((part ^ own[at] ^ DELETED) + mix(other[at]))  # noqa: B023, E731
                    whole = np.flatnonzero(asked)
                    wholes.append(key(whole, sums[whole]))
                    owner.append(rows[whole])
                    used = sets[np.repeat(np.diff(before) > 0, size)]
                    one = np.flatnonzero(asked[place])
                    at = place[one]
                    less.append(key(at, sums[at] - mix(used[one] ^ PART)))
                    less_owner.append(rows[at])
                lists = [_lists(np.concatenate(k), np.concatenate(o), n) for k, o in ((less, less_owner), (wholes, owner))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), *lists], ["node", "keys", "wholes"])

    return run


def _often(spread: DataFrame, most_shared: int) -> DataFrame:
    """Keys that more than about ``most_shared`` nodes have, told by one node in so many.

    The sample's nodes are chosen by their hash. Which keys it tells is a matter of cost:
    all nodes skip the same ones, so no link depends on it.
    """
    one_in = max(1, most_shared // 8)
    some = spread.where(F.pmod(F.xxhash64("node"), F.lit(one_in)) == 0)
    return cut(some.groupBy("bucket").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") * one_in > most_shared).select("bucket"))


def _with_skipped(texts: DataFrame, skipped: DataFrame) -> DataFrame:
    """Texts of the nodes that skip segments, with these; up to BROADCAST_IDS nodes, no other text is shuffled."""
    if skipped.count() <= BROADCAST_IDS:
        texts = texts.join(F.broadcast(skipped.select("node")), "node", "left_semi")
    return texts.join(skipped, "node").select("node", "text", "skipped")


def similarity_classes(docs: DataFrame, words: int = 5, threshold_percent: int = 80, id_col: str = "doc_id", text_col: str = "text", most_shared: int = MOST_SHARED) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest id that links reach).

    Rows link if the intersection of their shingle sets is at least ``threshold_percent``
    hundredths of the union. Shingles are compared by 64-bit hashes, equal sets by 128 bits.
    """
    partition = Partition(threshold_percent)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = cut(rows.mapInArrow(_sign(words, partition), SIGNED))
    keyed = signed.where("k0 IS NOT NULL AND doc_id IS NOT NULL")
    reps, own_rows = representatives(keyed)
    nodes = cut(own_rows.select("node", F.col("n_shingles").alias("n"), "keys", *SET_BITMAP))

    spread = nodes.select(F.explode("keys").alias("bucket"), "node")
    often = _often(spread, most_shared)
    if n_often := often.count():
        small = F.broadcast(often) if n_often <= BROADCAST_IDS else often
        skipped = spread.join(small, "bucket").groupBy("node").agg(F.collect_set("bucket").alias("skipped"))
        texts = rows.where("doc_id IS NOT NULL AND text IS NOT NULL").withColumnRenamed("doc_id", "node")
        deleted = cut(_with_skipped(texts, cut(skipped)).mapInArrow(_deletions(words, partition), "node long, keys array<long>, wholes array<long>"))
        of = lambda keys, whole: deleted.select(F.explode(keys).alias("bucket"), "node", F.lit(whole).alias("whole"))
        members = members_of(spread.join(small, "bucket", "left_anti")).unionByName(members_of(of("keys", False).unionByName(of("wholes", True)), "whole"))
    else:
        members = members_of(spread)
    members = cut(members)

    # the texts of one id are one vertex
    own = keyed.join(reps, ["k0", "k1"]).select("doc_id", "node")
    several = own.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a < last")
    same = own.join(several, "doc_id").where("a < node").select("a", F.col("node").alias("b")).distinct()
    found = components_of(members, nodes.drop("keys"), same, lambda x, y: sets_may_link(x, y, threshold_percent), confirming(rows, words, threshold_percent))
    labels = reps.join(found, "node", "left").select("k0", "k1", F.coalesce("component", "node").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("k0")).alias("k0"), "k1").join(labels, ["k0", "k1"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
