"""Approximate nearest neighbours: a robust-pruned directed graph per shard, searched with a beam.

Equal vectors are one node of the index; their ids are met again after the search, of
which the smallest few can be among a query's nearest. Nodes are dealt to cells by their
nearest centroid, and a cell of more than SHARD_ROWS nodes to several shards by hash. A
shard's graph grows in batches that double: greedy searches from the entry propose
neighbours, relaxed distance pruning keeps diverse edges (a candidate goes if a kept
neighbour is nearer to it by the factor ALPHA), and edges back are pruned again where a
node has too many. A second pass runs over all nodes. A query asks the shards of its
nearest cells by beam search, and its best of all of them are ranked by exact distances.

Centroids are fitted on a bounded sample (64 vectors a centroid, SAMPLE_VALUES
components for vectors of one length), and are MOST_CELLS at most, of CENTROID_VALUES
components together; every row is indexed. How many cells a query asks is measured: the
true neighbours of up to CALIBRATED queries, found among all nodes, tell how many of the
nearest cells hold the share COVERED of them. Clustered vectors need few cells, whatever
their number; vectors without any structure need most of them, as no routing can tell
where their neighbours are. ``probes`` sets the number instead; 0 asks every cell.

An index is a table, so it may be written and queried later. Queries meet a shard in
blocks of about QUERY_BLOCK; a task holds one shard and one block.

Defined cases: vectors that are null, empty or zero, or hold a null or a component that
is not finite, take no part, as rows with a null id; vectors of several lengths are
compared with those of their own length; rows that repeat an id and its vector count
once, and a row is never its own id's neighbour; fewer candidates give fewer rows; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import cut

SHARD_ROWS = 8192
DEGREE, BUILD_BEAM, ALPHA = 32, 32, 1.2
SEARCH_BEAM = 160
BUILD_BATCH, QUERY_BLOCK = 512, 1024
MOST_PARTITIONS = 20_000
#: Bounds of the routing: centroids for vectors of one length and their sample, components of all centroids, lengths that have centroids.
MOST_CELLS, SAMPLE_VALUES, CENTROID_VALUES, ROUTED_LENGTHS = 4096, 8 << 20, 4 << 20, 256
#: Queries for each length that the number of probed cells is measured on, and the share of true neighbours that it must hold.
CALIBRATED, COVERED = 64, 0.97

SHARD = "dim int, cell int, shard int, h0 binary, h1 binary, least binary, vectors binary, edges binary, entry int"
FOUND = "q0 long, q1 long, h0 long, h1 long, least long, score double"


def distances(points: np.ndarray, vectors: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances of each point to the vectors that its row of ``ids`` names."""
    x = vectors[ids] - points[:, None, :]
    return np.einsum("ijk,ijk->ij", x, x)


def beam_search(vectors: np.ndarray, edges: np.ndarray, entry: int, points: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` nearest nodes that greedy searches meet, for many points at once: ids (-1: none) and squared distances, nearest first."""
    n = len(points)
    ids = np.full((n, beam), -1, np.int64)
    far = np.full((n, beam), np.inf, vectors.dtype)
    open_ = np.zeros((n, beam), bool)
    ids[:, 0], open_[:, 0] = entry, True
    far[:, 0] = distances(points, vectors, ids[:, :1])[:, 0]
    met = np.zeros((n, len(vectors)), bool)
    met[:, entry] = True
    live = np.arange(n)
    while len(live):
        at = open_[live].argmax(axis=1)  # the beam is sorted, so this is the nearest that was not expanded
        more = open_[live, at]
        live, at = live[more], at[more]
        if not len(live):
            break
        open_[live, at] = False
        near = edges[ids[live, at]]
        new = near >= 0
        safe = np.where(new, near, 0)
        new &= ~met[live[:, None], safe]
        r, c = np.nonzero(new)
        met[live[r], safe[r, c]] = True
        x = vectors[safe[r, c]] - points[live[r]]
        d = np.full(near.shape, np.inf, vectors.dtype)
        d[r, c] = np.einsum("ij,ij->i", x, x)
        all_far = np.concatenate([far[live], d], axis=1)
        order = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
        rows = np.arange(len(live))[:, None]
        ids[live] = np.concatenate([ids[live], np.where(new, near, -1)], axis=1)[rows, order]
        far[live] = all_far[rows, order]
        open_[live] = np.concatenate([open_[live], new], axis=1)[rows, order]
    return ids, far


def robust_prune(vectors: np.ndarray, nodes: np.ndarray, ids: np.ndarray, far: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Of each node's candidates (sorted by squared distance; -1: none), up to ``degree`` diverse ones."""
    out = np.full((len(nodes), degree), -1, np.int64)
    step = max(1, (4 << 20) // ids.shape[1] ** 2)
    for at in range(0, len(nodes), step):
        part = slice(at, at + step)
        alive = (ids[part] >= 0) & (ids[part] != nodes[part, None]) & np.isfinite(far[part])
        among = vectors[np.maximum(ids[part], 0)]
        norm = np.einsum("ijk,ijk->ij", among, among)
        between = norm[:, :, None] + norm[:, None, :] - 2 * (among @ among.transpose(0, 2, 1))
        between *= alpha * alpha
        for k in range(degree):
            best = alive.argmax(axis=1)
            some = np.flatnonzero(alive[np.arange(len(alive)), best])
            if not len(some):
                break
            best = best[some]
            out[at + some, k] = ids[at + some, best]
            alive[some] &= between[some, best] > far[at + some]
            alive[some, best] = False
    return out


def _merged(ids: np.ndarray, extra: np.ndarray, extra_far: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two candidate lists as one, sorted, without repeats."""
    ids, far = np.concatenate([ids, extra], axis=1), np.concatenate([far, extra_far], axis=1)
    by_id = np.argsort(ids, axis=1, kind="stable")
    rows = np.arange(len(ids))[:, None]
    ids, far = ids[rows, by_id], far[rows, by_id]
    again = np.zeros(ids.shape, bool)
    again[:, 1:] = ids[:, 1:] == ids[:, :-1]
    far = np.where(again | (ids < 0), np.inf, far)
    order = np.argsort(far, axis=1, kind="stable")
    return np.where(np.isfinite(far), ids, -1)[rows, order], far[rows, order]


def _with_own_edges(vectors: np.ndarray, edges: np.ndarray, nodes: np.ndarray, ids: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own = edges[nodes]
    d = np.where(own >= 0, distances(vectors[nodes], vectors, np.maximum(own, 0)), np.inf)
    return _merged(ids, own, d, far)


def build_graph(vectors: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """Edges (a row of node numbers, -1: none) and the entry (the node nearest to the mean)."""
    n = len(vectors)
    edges = np.full((n, degree), -1, np.int64)
    x = vectors - vectors.mean(axis=0)
    entry = int(np.einsum("ij,ij->i", x, x).argmin())
    rest = np.random.default_rng(n).permutation(n)
    rest = rest[rest != entry]
    for last in (False, True):
        at, step = 0, BUILD_BATCH if last else 8
        while at < len(rest):
            nodes = rest[at : at + step]
            at += step
            step = min(2 * step, BUILD_BATCH)
            ids, far = _with_own_edges(vectors, edges, nodes, *beam_search(vectors, edges, entry, vectors[nodes], beam))
            edges[nodes] = robust_prune(vectors, nodes, ids, far, degree, alpha if last else 1.0)
            _link_back(vectors, edges, nodes, degree, alpha if last else 1.0)
    return edges, entry


def _link_back(vectors: np.ndarray, edges: np.ndarray, nodes: np.ndarray, degree: int, alpha: float) -> None:
    """Give the neighbours of ``nodes`` edges back to them; where there is no room, prune."""
    source = np.repeat(nodes, degree)
    target = edges[nodes].reshape(-1)
    source, target = source[target >= 0], target[target >= 0]
    present = (edges[target] == source[:, None]).any(axis=1)
    source, target = source[~present], target[~present]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    if not len(target):
        return
    to, first, count = np.unique(target, return_index=True, return_counts=True)
    for width in np.unique(np.ceil(count / 32).astype(np.int64)):  # lists of similar length together
        some = np.flatnonzero(np.ceil(count / 32) == width)
        extra = np.full((len(some), 32 * int(width)), -1, np.int64)
        place = np.arange(extra.shape[1])[None, :]
        fill = place < count[some][:, None]
        extra[fill] = source[(first[some][:, None] + place)[fill]]
        kept, joined = edges[to[some]], np.concatenate([edges[to[some]], extra], axis=1)
        room = (kept >= 0).sum(axis=1) + count[some] <= degree
        # room: the edges move to the front, in their order
        front = np.argsort(joined[room] < 0, axis=1, kind="stable")[:, :degree]
        edges[to[some][room]] = joined[room][np.arange(int(room.sum()))[:, None], front]
        full = np.flatnonzero(~room)
        for part in np.array_split(full, max(1, len(full) // 1024)):
            if len(part):
                own = to[some][part]
                d = np.where(joined[part] >= 0, distances(vectors[own], vectors, np.maximum(joined[part], 0)), np.inf)
                by_far = np.argsort(d, axis=1, kind="stable")
                rows = np.arange(len(part))[:, None]
                edges[own] = robust_prune(vectors, own, joined[part][rows, by_far], d[rows, by_far], degree, alpha)


def _usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, vector (doubles), dim and the vector's 128-bit hash; only rows that take part, each once."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double") + F.lit(0.0))  # no negative zero
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    out = rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector")).where("vec_id IS NOT NULL AND vector IS NOT NULL")
    out = out.where(~F.coalesce(bad, F.lit(True)) & F.exists("vector", lambda x: x != 0))
    return out.withColumns({"dim": F.size("vector"), "h0": F.xxhash64("vector"), "h1": F.xxhash64(F.lit(1), "vector")})


def smallest_ids(usable: DataFrame, most: int) -> DataFrame:
    """h0, h1 and vec_id: of each vector's ids the ``most`` smallest (a rank limit that Spark applies before it shuffles)."""
    w = Window.partitionBy("h0", "h1").orderBy("vec_id")
    return usable.select("h0", "h1", "vec_id").withColumn("_k", F.dense_rank().over(w)).where(F.col("_k") <= most).select("h0", "h1", "vec_id").distinct()


def vectors_by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, rows and vectors of each length in a batch with dim and vector."""
    dims = batch.column(batch.schema.get_field_index("dim")).to_numpy().astype(np.int64)
    flat = batch.column(batch.schema.get_field_index("vector")).flatten().to_numpy(zero_copy_only=False)
    begins = np.cumsum(dims) - dims
    for d in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == d)
        yield d, rows, flat[begins[rows][:, None] + np.arange(d)].astype(np.float32)


def to_centroids(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances less the vectors' own squares."""
    return np.einsum("ij,ij->i", centroids, centroids)[None, :] - 2 * (vectors @ centroids.T)


def k_means(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centroids of a sample; one that loses all its vectors stays."""
    centroids = sample[np.random.default_rng(k).permutation(len(sample))[:k]].copy()
    for _ in range(rounds):
        at = np.concatenate([to_centroids(sample[i : i + 4096], centroids).argmin(axis=1) for i in range(0, len(sample), 4096)])
        order = np.argsort(at, kind="stable")
        own, first, count = np.unique(at[order], return_index=True, return_counts=True)
        centroids[own] = np.add.reduceat(sample[order], first, axis=0) / count[:, None]
    return centroids


def fit_centroids(nodes: DataFrame, shard_rows: int) -> dict[int, np.ndarray]:
    """Centroids for the lengths that have more nodes than a shard: at most CENTROID_VALUES components."""
    counts = nodes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard_rows).orderBy(F.desc("n"), "dim").limit(ROUTED_LENGTHS).collect()
    cells = {r.dim: min(MOST_CELLS, math.ceil(r.n / (0.7 * shard_rows))) for r in counts}
    share = min(1.0, CENTROID_VALUES / max(1, sum(d * k for d, k in cells.items())))
    cells = {d: max(1, int(k * share)) for d, k in cells.items()}
    if not cells:
        return {}
    rows = {r.dim: min(1.0, min(64 * cells[r.dim], SAMPLE_VALUES // r.dim + 1) / r.n) for r in counts}
    wanted = F.element_at(F.create_map(*[F.lit(x) for d, share in rows.items() for x in (d, int(share * (1 << 30)))]), F.col("dim"))
    sample = nodes.where(F.col("dim").isin(list(cells))).where(F.pmod(F.xxhash64("h0", "h1"), F.lit(1 << 30)) < wanted).select("dim", "h0", "vector")

    def fit(table: pa.Table) -> pa.Table:
        d = table.column("dim")[0].as_py()
        table = table.sort_by("h0")
        vectors = np.concatenate([c.flatten().to_numpy() for c in table.column("vector").chunks]).reshape(table.num_rows, d)
        return pa.table({"dim": pa.array([d], pa.int32()), "centroids": pa.array([k_means(vectors.astype(np.float32), cells[d]).astype("<f4").tobytes()], pa.binary())})

    fitted = sample.groupBy("dim").applyInArrow(fit, "dim int, centroids binary").collect()
    return {r.dim: np.frombuffer(bytes(r.centroids), "<f4").reshape(-1, r.dim) for r in fitted}


def with_cell(nodes: DataFrame, centroids: dict[int, np.ndarray]) -> DataFrame:
    """Add the cell of each node: its nearest centroid, 0 for lengths without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.zeros(batch.num_rows, np.int32)
            for d, rows, vectors in vectors_by_length(batch):
                for i in range(0, len(rows) if d in centroids else 0, 4096):
                    cell[rows[i : i + 4096]] = to_centroids(vectors[i : i + 4096], centroids[d]).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    return nodes.mapInArrow(run, T.StructType([*nodes.schema.fields, T.StructField("cell", T.IntegerType())]))


def with_probes(queries: DataFrame, centroids: dict[int, np.ndarray], probes: dict[int, int]) -> DataFrame:
    """h0, h1, dim, vector and cell: a row for each cell that a query asks, the nearest ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, cell = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for d, rows, vectors in vectors_by_length(batch):
                most = probes.get(d) or len(centroids.get(d, "1"))
                asked = np.argsort(to_centroids(vectors, centroids[d]), axis=1, kind="stable")[:, :most] if d in centroids else np.zeros((len(rows), 1), np.int64)
                row.append(np.repeat(rows, asked.shape[1]))
                cell.append(asked.reshape(-1))
            taken = batch.take(pa.array(np.concatenate(row)))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(np.concatenate(cell).astype(np.int32))], [*batch.schema.names, "cell"])

    return queries.mapInArrow(run, T.StructType([*queries.schema.fields, T.StructField("cell", T.IntegerType())]))


def measured_probes(placed: DataFrame, queries: DataFrame, centroids: dict[int, np.ndarray], k: int) -> dict[int, int]:
    """For each length, how many of its nearest cells a query must ask to meet the share COVERED of its ``k`` nearest."""
    if not centroids:
        return {}
    by_hash = Window.partitionBy("dim").orderBy(F.xxhash64("h1", "h0"), "h0", "h1")
    some = queries.where(F.col("dim").isin(list(centroids))).withColumn("_k", F.row_number().over(by_hash)).where(F.col("_k") <= CALIBRATED).select("dim", "vector").collect()
    sample = {d: np.array([r.vector for r in some if r.dim == d], np.float32) for d in {r.dim for r in some}}
    names = ["dim", "query", "score", "cell"]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column(batch.schema.get_field_index("cell")).to_numpy()
            for d, rows, vectors in vectors_by_length(batch):
                if d not in sample:
                    continue
                far = np.einsum("ij,ij->i", vectors, vectors)[None, :] - 2 * (sample[d] @ vectors.T) + np.einsum("ij,ij->i", sample[d], sample[d])[:, None]
                order = np.argsort(far, axis=1, kind="stable")[:, : k + 1]
                n, m = order.shape
                columns = (np.full(n * m, d, np.int32), np.repeat(np.arange(n, dtype=np.int32), m), np.take_along_axis(far, order, 1).reshape(-1).astype(np.float64), cells[rows[order]].reshape(-1))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    found = placed.select("dim", "vector", "cell").mapInArrow(best, "dim int, query int, score double, cell int")
    near = Window.partitionBy("dim", "query").orderBy("score", "cell")
    rows = found.withColumn("_k", F.row_number().over(near)).where(F.col("_k") <= k + 1).where("_k > 1").collect()  # the first is the query itself
    out = {}
    for d, points in sample.items():
        place = np.argsort(np.argsort(to_centroids(points, centroids[d]), axis=1, kind="stable"), axis=1)
        needed = np.sort([place[r["query"], r.cell] for r in rows if r.dim == d])
        out[d] = int(needed[min(len(needed) - 1, math.ceil(COVERED * len(needed)) - 1)]) + 1 if len(needed) else 0
    return out


def cell_shards(placed: DataFrame, shard_rows: int) -> DataFrame:
    """dim, cell and the number of shards of each cell."""
    return placed.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(shard_rows)).cast("int").alias("shards"))


def build_index(placed: DataFrame, shards: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """A row for each shard of the distinct vectors ``placed`` (h0, h1, dim, vector, least (the smallest of its ids) and cell)."""
    dealt = placed.join(shards, ["dim", "cell"]).withColumn("shard", F.pmod(F.xxhash64("h0", "h1"), F.col("shards")).cast("int"))

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by([("h0", "ascending"), ("h1", "ascending")])
        vectors = np.concatenate([c.flatten().to_numpy() for c in table.column("vector").chunks]).reshape(table.num_rows, -1)
        edges, entry = build_graph(vectors.astype(np.float32))
        keys = [np.concatenate([c.to_numpy() for c in table.column(h).chunks]) for h in ("h0", "h1", "least")]
        out = [*(table.column(c)[0].as_py() for c in ("dim", "cell", "shard")), *(k.astype("<i8").tobytes() for k in keys), vectors.astype("<f8").tobytes(), edges.astype("<i4").tobytes(), entry]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int32())
        return pa.Table.from_arrays([pa.array([x], t) for x, t in zip(out, kinds, strict=True)], [x.split()[0] for x in SHARD.split(", ")])

    # a shard's bytes are few and its work is much, so shards are not put together by size
    n = shards.agg(F.sum("shards")).first()[0] or 0
    parts = min(max(int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * n), MOST_PARTITIONS)
    return dealt.select("dim", "cell", "shard", "h0", "h1", "least", "vector").repartition(parts, "dim", "cell", "shard").groupBy("dim", "cell", "shard").applyInArrow(build, SHARD)


def search_index(index: DataFrame, shards: DataFrame, probed: DataFrame, k: int, beam: int = SEARCH_BEAM) -> DataFrame:
    """For each distinct query vector and cell (h0, h1, dim, vector, cell) up to ``k`` nodes of each of its shards: q0, q1, h0, h1, least, score.

    Nodes at one distance are taken by their smallest id.
    """
    sizes = probed.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(QUERY_BLOCK)).cast("int").alias("blocks")).join(shards, ["dim", "cell"])
    asked = probed.join(sizes, ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("h1", "h0"), F.col("blocks")).cast("int"))
    asked = asked.select("dim", "cell", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "block", F.col("h0").alias("q0"), F.col("h1").alias("q1"), "vector")
    held = index.join(sizes.select("dim", "cell", "blocks"), ["dim", "cell"]).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [x.split()[0] for x in FOUND.split(", ")]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in kinds], names)
        row = left.to_pylist()[0]
        h0, h1, least = (np.frombuffer(row[h], "<i8") for h in ("h0", "h1", "least"))
        vectors = np.frombuffer(row["vectors"], "<f8").reshape(len(h0), -1)
        edges = np.frombuffer(row["edges"], "<i4").reshape(len(h0), -1).astype(np.int64)
        small = vectors.astype(np.float32)
        asked = np.concatenate([c.flatten().to_numpy() for c in right.column("vector").chunks]).reshape(right.num_rows, -1)
        q0, q1 = (np.concatenate([c.to_numpy() for c in right.column(q).chunks]) for q in ("q0", "q1"))
        parts = []
        for at in range(0, len(asked), 256):
            points = asked[at : at + 256]
            ids, _ = beam_search(small, edges, row["entry"], points.astype(np.float32), min(max(beam, k), max(len(h0), 1)))
            exact = np.where(ids >= 0, np.sqrt(distances(points, vectors, np.maximum(ids, 0))), np.inf)
            order = np.lexsort((least[np.maximum(ids, 0)], exact), axis=1)[:, :k]
            rows = np.arange(len(points))[:, None]
            ids, exact = ids[rows, order], exact[rows, order]
            r, c = np.nonzero(np.isfinite(exact))
            hit = ids[r, c]
            parts.append((q0[at + r], q1[at + r], h0[hit], h1[hit], least[hit], exact[r, c]))
        return pa.Table.from_arrays([pa.array(np.concatenate(p), t) for p, t in zip(zip(*parts, strict=True), kinds, strict=True)], names)

    return held.groupBy("dim", "cell", "shard", "block").cogroup(asked.groupBy("dim", "cell", "shard", "block")).applyInArrow(search, FOUND)


def nearest(rows: DataFrame, is_query: str, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, beam: int = SEARCH_BEAM, probes: int | None = None) -> DataFrame:
    """The ``k`` nearest rows found for each row that fits the SQL condition ``is_query`` (on vec_id): query_id, rank, vec_id, score.

    Nearest by Euclidean distance in double precision, ties to the smaller vec_id.
    """
    usable = _usable(rows, id_col, vector_col)
    distinct = usable.groupBy("h0", "h1", "dim").agg(F.any_value("vector").alias("vector"), F.min("vec_id").alias("least"))
    nodes = cut(distinct)
    centroids = fit_centroids(nodes, shard_rows)
    placed = cut(with_cell(nodes, centroids))
    shards = cut(cell_shards(placed, shard_rows))
    index = cut(build_index(placed, shards, shard_rows))
    asking = cut(usable.where(is_query).select("h0", "h1", F.col("vec_id").alias("query_id")).distinct())
    asked = nodes.join(asking.select("h0", "h1").distinct(), ["h0", "h1"])
    needed = measured_probes(placed, asked, centroids, k) if probes is None else dict.fromkeys(centroids, probes)
    found = search_index(index, shards, with_probes(asked, centroids, needed), k + 1, beam)
    # a query's own vector is one of the k + 1; each holds k + 1 ids at most that can matter
    w = Window.partitionBy("q0", "q1").orderBy("score", "least", "h0", "h1")
    found = cut(found.withColumn("_k", F.dense_rank().over(w)).where(F.col("_k") <= k + 1).drop("_k"))
    members = smallest_ids(usable, k + 1)
    candidates = found.join(members, ["h0", "h1"]).select(F.col("q0").alias("h0"), F.col("q1").alias("h1"), "score", "vec_id")
    # ranked once for each vector that is asked for, with a place more than k for the query's own id
    near = Window.partitionBy("h0", "h1").orderBy("score", "vec_id")
    ranked = candidates.withColumn("_k", F.row_number().over(near)).where(F.col("_k") <= k + 1)
    answers = ranked.groupBy("h0", "h1").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("near"))
    own = asking.join(answers, ["h0", "h1"]).select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    listed = own.select("query_id", F.posexplode("near").alias("place", "hit"))
    return listed.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


def nearest_by_brute_force(rows: Iterator[tuple[int, list[float]]], queries: list[int], k: int) -> dict[int, list[tuple[int, float]]]:
    """The exact answers over a small list of usable rows: for tests and recall."""
    ids, vectors = map(np.array, zip(*sorted(rows), strict=True))
    out = {}
    for q in queries:
        d = np.sqrt(((vectors - vectors[ids == q][0]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(d[i])) for i in order]
    return out
