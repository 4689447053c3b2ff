"""Hard negatives from exact integer scores, as a block matrix multiply over rows and dimensions.

Rows are numbered by label and id and cut into blocks, as are the anchors; each block is
cut into chunks of dimensions. A task multiplies one chunk of an anchor block with the same
chunk of a row block; the partial int64 score tiles are shuffled to their tile and added
there, and a tile yields the best few rows for each of its anchors, which a ranking over
the tiles reduces. No task holds more than a tile and its chunks.

A first multiply meets only blocks that share a label, and finds the anchors' positives.
Their scores are the windows of the second, which meets all blocks: a tile yields the best
rows of other labels in each window.

Components are scaled and rounded down to integers, so scores do not depend on the order
of additions. Products are made in doubles where these are exact, else in integers.

Defined cases: rows with a null id, label or vector, or with a null or non-finite
component, take no part; a shorter vector counts as having zeros beyond its end; rows that
repeat an id are rows of their own (each is an anchor, a positive or a negative for the
others), and come in the order of their numbers after the score and the id; an anchor
without positives, and a window without negatives, give no rows; an empty table gives an
empty result; other columns are not read. Scores that may leave 64 bits raise ValueError.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.tables import running
from tessella.llm.common import cut

#: Anchors and rows of a block, and dimensions of a chunk.
ANCHOR_BLOCK, ROW_BLOCK, DIM_CHUNK = 256, 2048, 32
NOTHING = np.iinfo(np.int64).min

BLOCK = "block long, chunk int, n int, width int, data binary, ids array<long>, labels array<long>, numbers array<long>"
TILE = "i long, j long, width int, tile binary, a_ids array<long>, a_labels array<long>, a_numbers array<long>, r_ids array<long>, r_labels array<long>, r_numbers array<long>, w_anchor array<long>, w_place array<int>, w_score array<long>"
FOUND = "a_number long, anchor_id long, place int, number long, id long, score long"


def narrow(x: np.ndarray) -> tuple[int, bytes]:
    """The width in bytes of the smallest integers that hold ``x``, and ``x`` in them."""
    low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
    width = next(w for w in (1, 2, 4, 8) if -(1 << 8 * w - 1) <= low and high < 1 << 8 * w - 1)
    return width, x.astype(f"<i{width}").tobytes()


def _arrow(schema: str, columns: list[list]) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    fields = [x.split(" ") for x in schema.split(", ")]
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _packed(dims: int, chunk: int, scale: float):
    """A block's rows as chunks of integers; the first chunk has the rows' ids, labels and numbers."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks().sort_by("number")
        vectors = rows.column("vector").combine_chunks()
        lengths = vectors.value_lengths().to_numpy()
        owner = np.repeat(np.arange(len(rows)), lengths)
        place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        whole = np.zeros((len(rows), dims), np.int64)
        whole[owner, place] = np.floor(vectors.flatten().to_numpy(zero_copy_only=False) * scale).astype(np.int64)
        told = [rows.column(c).to_numpy().tolist() for c in ("id", "label", "number")]
        out = []
        for k, at in enumerate(range(0, max(dims, 1), chunk)):
            out.append([key[0].as_py(), k, len(rows), *narrow(whole[:, at : at + chunk]), *(told if not k else [[], [], []])])
        return _arrow(BLOCK, [list(c) for c in zip(*out, strict=True)])

    return run


def _product(key: tuple, anchors: pa.Table, rows: pa.Table) -> pa.Table:
    """The partial tile of one chunk; the first chunk's takes along what the tile's reduction needs."""
    if not len(anchors) or not len(rows):
        return _arrow(TILE, [[] for _ in TILE.split(", ")])
    a, r = anchors.to_pylist()[0], rows.to_pylist()[0]
    x, y = (np.frombuffer(b["data"], f"<i{b['width']}").reshape(b["n"], -1).astype(np.int64) for b in (a, r))
    most = int(np.abs(x).max(initial=0)) * int(np.abs(y).max(initial=0)) * max(1, x.shape[1])
    tile = (x.astype(float) @ y.T.astype(float)).astype(np.int64) if most < 1 << 53 else x @ y.T
    told = [b[c] for b in (a, r) for c in ("ids", "labels", "numbers")]
    return _arrow(TILE, [[v] for v in (key[0].as_py(), key[1].as_py(), *narrow(tile), *told, a["w_anchor"] or [], a["w_place"] or [], a["w_score"] or [])])


class Tile:
    """A tile's scores as keys that order a row's entries by score, then by smaller id and number."""

    def __init__(self, parts: list[dict]):
        first = next(p for p in parts if p["a_ids"])
        self.a_ids, self.a_labels, self.a_numbers, self.r_ids, self.r_labels, self.r_numbers = (np.array(first[f"{s}_{c}"], np.int64) for s in "ar" for c in ("ids", "labels", "numbers"))
        scores = np.zeros((len(self.a_ids), len(self.r_ids)), np.int64)
        for p in parts:
            scores += np.frombuffer(p["tile"], f"<i{p['width']}").reshape(scores.shape)
        self.windows = [np.array(first[c], np.int64) for c in ("w_anchor", "w_place", "w_score")]
        self.order = np.lexsort((self.r_numbers, self.r_ids))
        self.bits = max(1, len(self.order)).bit_length()
        place = np.empty(len(self.order), np.int64)
        place[self.order] = np.arange(len(self.order))
        #: Scores too large to share a key with a place are told by their rank among the tile's.
        self.levels = np.unique(scores) if np.abs(scores).max(initial=0) >> 62 - self.bits else None
        leveled = scores if self.levels is None else np.searchsorted(self.levels, scores)
        self.keys = (leveled << self.bits) + ((1 << self.bits) - 1 - place)[None, :]

    def score(self, keys: np.ndarray) -> np.ndarray:
        return keys >> self.bits if self.levels is None else self.levels[keys >> self.bits]

    def column(self, keys: np.ndarray) -> np.ndarray:
        return self.order[(1 << self.bits) - 1 - (keys & (1 << self.bits) - 1)]

    def least(self, score: np.ndarray) -> np.ndarray:
        """The smallest key that a score of at least this much can have."""
        return (score if self.levels is None else np.searchsorted(self.levels, score)) << self.bits

    def found(self, anchor: np.ndarray, place: np.ndarray, keys: np.ndarray) -> pa.Table:
        at = self.column(keys)
        return _arrow(FOUND, [self.a_numbers[anchor], self.a_ids[anchor], place.astype(np.int32), self.r_numbers[at], self.r_ids[at], self.score(keys)])


def _positives(k: int):
    """The best ``k`` other rows of each anchor's label in a tile."""

    def run(key: tuple, parts: pa.Table) -> pa.Table:
        tile = Tile(parts.to_pylist())
        fits = (tile.a_labels[:, None] == tile.r_labels[None, :]) & (tile.a_numbers[:, None] != tile.r_numbers[None, :])
        keys = np.where(fits, tile.keys, NOTHING)
        most = min(k, keys.shape[1])
        best = np.partition(keys, keys.shape[1] - most, axis=1)[:, keys.shape[1] - most :]
        anchor, at = np.nonzero(best != NOTHING)
        return tile.found(anchor, np.zeros(len(anchor)), best[anchor, at])

    return run


def _negatives(k: int, low_percent: int, high_percent: int):
    """The best ``k`` rows of other labels in each window of a tile."""

    def run(key: tuple, parts: pa.Table) -> pa.Table:
        tile = Tile(parts.to_pylist())
        keys = np.sort(np.where(tile.a_labels[:, None] != tile.r_labels[None, :], tile.keys, NOTHING), axis=1)
        index = {n: x for x, n in enumerate(tile.a_numbers.tolist())}
        anchor, place, best = [], [], []
        for number, own, score in zip(*(w.tolist() for w in tile.windows), strict=True):
            row = index[number]
            low, high = -(-low_percent * score // 100), high_percent * score // 100
            ends = tile.least(np.array([low, high + 1]))
            first, last = np.searchsorted(keys[row], ends)
            first = max(int(first), int(np.searchsorted(keys[row], NOTHING, "right")))
            for at in range(max(first, int(last) - k), int(last)):
                anchor.append(row)
                place.append(own)
                best.append(keys[row, at])
        return tile.found(np.array(anchor, np.int64), np.array(place, np.int64), np.array(best, np.int64))

    return run


def _ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id", "number")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    df: DataFrame, anchor: str | Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | Column = "label", positives: int = 5, negatives: int = 3, low_percent: int = 50, high_percent: int = 95,
    scale: float = 256.0, anchor_block: int = ANCHOR_BLOCK, row_block: int = ROW_BLOCK, dim_chunk: int = DIM_CHUNK,
) -> DataFrame:
    """Columns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows that ``anchor`` (over the columns id and label) chooses. An anchor's
    positives are its first ``positives`` other rows of its label by score; for each of
    them come the first ``negatives`` rows of other labels with scores from ``low_percent``
    to ``high_percent`` hundredths of the positive's.
    """
    label = label_col if isinstance(label_col, Column) else F.col(f"`{label_col}`")
    kept = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("long").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & (v < F.lit(float("inf"))) & (v > F.lit(float("-inf"))))
    kept = kept.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)
    # the numbers of repeated rows are told apart once, and stay
    numbered = cut(running(kept, [F.col("label"), F.col("id")], F.lit(0)).select("id", "label", "vector", F.col("_number").cast("long").alias("number")))
    choice = F.expr(anchor) if isinstance(anchor, str) else anchor
    chosen = cut(running(numbered.where(choice), [F.col("number")], F.lit(0)).withColumn("own", F.col("_number").cast("long")).drop("_number", "_before"))
    most = F.max(F.array_max(F.transform("vector", lambda v: F.abs(F.floor(v * F.lit(scale)).cast("double")))))
    sizes = numbered.agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("vector")).alias("dims"), most.alias("most")).first()
    anchors = chosen.count()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not anchors:
        return df.sparkSession.createDataFrame([], schema)
    dims, most = sizes["dims"] or 0, int(sizes["most"] or 0)
    if dims * most * most >= 1 << 62:
        raise ValueError(f"components of up to {most} in {dims} dimensions make scores beyond 64 bits")
    pack = _packed(dims, dim_chunk, scale)
    whole_div = lambda x, n: F.call_function("div", x, F.lit(n))
    rows = cut(numbered.groupBy(whole_div(F.col("number"), row_block).alias("block")).applyInArrow(pack, BLOCK))
    asked = cut(chosen.groupBy(whole_div(F.col("own"), anchor_block).alias("block")).applyInArrow(pack, BLOCK))
    n_rows, n_asked = -(-sizes["rows"] // row_block), -(-anchors // anchor_block)

    def tiles(left: DataFrame, right: DataFrame, reduce_tile) -> DataFrame:
        """Both sides have i, j and chunk: multiply chunk by chunk, add to tiles, and reduce each tile."""
        partial = left.groupBy("i", "j", "chunk").cogroup(right.groupBy("i", "j", "chunk")).applyInArrow(_product, TILE)
        return partial.groupBy("i", "j").applyInArrow(reduce_tile, FOUND)

    # blocks that share a label: a label's rows lie in a run of blocks
    runs = numbered.groupBy("label").agg(whole_div(F.min("number"), row_block).alias("first"), whole_div(F.max("number"), row_block).alias("last"))
    own = chosen.select(whole_div(F.col("own"), anchor_block).alias("i"), "label").distinct()
    sharing = cut(own.join(runs, "label").select("i", F.explode(F.sequence("first", "last")).alias("j")).distinct())
    empty = {"w_anchor": F.lit(None).cast("array<long>"), "w_place": F.lit(None).cast("array<int>"), "w_score": F.lit(None).cast("array<long>")}
    left = asked.withColumnRenamed("block", "i").join(sharing, "i").withColumns(empty)
    right = rows.withColumnRenamed("block", "j").join(sharing, "j")
    best = cut(_ranked(tiles(left, right, _positives(positives)), ["a_number"], positives).drop("place"))

    # the positives' scores go to their anchors' blocks, as windows
    by_block = best.join(chosen.select(F.col("number").alias("a_number"), "own"), "a_number").groupBy(whole_div(F.col("own"), anchor_block).alias("i"))
    windows = by_block.agg(F.collect_list(F.struct("a_number", "rank", "score")).alias("w")).select("i", F.col("w.a_number").alias("w_anchor"), F.col("w.rank").alias("w_place"), F.col("w.score").alias("w_score"))
    left = asked.withColumnRenamed("block", "i").join(windows, "i").withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_rows - 1).cast("long"))))
    left = left.withColumns({w: F.when(F.col("chunk") == 0, F.col(w)) for w in empty})
    right = rows.withColumnRenamed("block", "j").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_asked - 1).cast("long"))))
    hard = _ranked(tiles(left, right, _negatives(negatives, low_percent, high_percent)), ["a_number", "place"], negatives)
    positive = best.select("a_number", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return hard.join(positive, ["a_number", "place"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mine_by_brute_force(rows: list[tuple], anchors: set[int], positives: int = 5, negatives: int = 3, low_percent: int = 50, high_percent: int = 95, scale: float = 256.0) -> list[tuple]:
    """The same for a small list of usable (id, label, vector), in Python's integers: for tests."""
    import math

    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    whole = [[math.floor(v * scale) for v in vector] for _, _, vector in rows]
    out = []
    for a, (anchor_id, label, _) in enumerate(rows):
        if anchor_id not in anchors:
            continue
        scored = [(-sum(x * y for x, y in zip(whole[a], whole[b])), rows[b][0], b) for b in range(len(rows)) if b != a]  # noqa: B905
        same = sorted(s for s in scored if rows[s[2]][1] == label)[:positives]
        other = sorted(s for s in scored if rows[s[2]][1] != label)
        for p, positive_id, _ in same:
            hits = [s for s in other if low_percent * -p <= 100 * -s[0] <= high_percent * -p][:negatives]
            out += [(anchor_id, positive_id, k, n[1], -p, -n[0]) for k, n in enumerate(hits, 1)]
    return out
