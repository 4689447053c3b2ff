"""Removal of repeated passages: difference-cover anchors nominate, full windows confirm.

A difference cover D modulo a period v has, for any two positions i and j, a shift
s < v with both i + s and j + s in D modulo v. Two equal windows of w words therefore
hold equal anchors, of w - v + 1 words, at positions that lie in D: hashing anchors
only there (6 of 31 positions) misses no match. Anchors that several documents share
are extended to the windows around them; a window that also starts in a document with
a smaller id is removed.

Anchors are counted by text, so exact copies nominate nothing. Of texts that occur
again only the smallest id's windows are compared, and the others lose all words if they
have a window at all. Nothing here pairs documents: anchors and windows are met by hash
aggregates and equi-joins, which split hot keys. Texts move to the places that are
nominated (to count windows, then to mark them), and to the words that go.

Windows are compared by 128-bit hashes, texts by 64-bit ones (128 bits for copies).

Defined cases: a null text has no words; a row with a null id keeps all words and removes
none elsewhere; rows that repeat an id are judged each, and don't remove each other's
words; an empty table gives an empty result; columns of the input named like an output
(n_words, n_removed, kept_text) are replaced, all others stay, whatever their names are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import column_buffers, cut, slices
from tessella.llm.textscan import run_hashes, word_hashes, words_of

SLICE_BYTES = 2 << 20
#: Perfect difference covers (fixed values): period and cover.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}

OUTPUTS = ["n_words", "n_removed", "kept_text"]
ANCHORS = "text_key long, hash long, pos int"
WINDOWS = "doc_id long, text_key long, h0 long, h1 long, pos int"


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The largest period whose anchors still have at least a third of the window's words."""
    return max((v, d) for v, d in COVERS.items() if window - v + 1 >= max(1, window // 3))


def _spread(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and places within them of ``count[i]`` items per row i."""
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)


def _anchors(window: int):
    period, cover = cover_for(window)
    length = window - period + 1
    wanted = np.zeros(period, bool)
    wanted[list(cover)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_buffers(batch.column(1))
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j in slices(offsets, SLICE_BYTES):
                part = data[offsets[i] : offsets[j]]
                starts, ends, before = words_of(part, offsets[i : j + 1] - offsets[i])
                words = np.diff(before)
                # a document without a whole window has nothing to match
                row, place = _spread(np.where(words >= window, words - length + 1, 0))
                chosen = wanted[place % period]
                row, place = row[chosen], place[chosen]
                if not len(row):
                    continue
                hashes = run_hashes(word_hashes(part, starts, ends), length)[before[row] + place].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[i + row]), pa.array(hashes), pa.array(place.astype(np.int32))],
                    ["text_key", "hash", "pos"],
                )

    return run


def _windows(window: int):
    period = cover_for(window)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_buffers(batch.column(2))
            ids, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            spots = batch.column(3)
            for i, j in slices(offsets, SLICE_BYTES):
                part = data[offsets[i] : offsets[j]]
                starts, ends, before = words_of(part, offsets[i : j + 1] - offsets[i])
                own = spots.slice(i, j - i)
                count = own.value_lengths().to_numpy(zero_copy_only=False)
                anchor = own.flatten().to_numpy() + np.repeat(before[:-1], count)
                # windows that hold an anchor begin up to period - 1 words before it
                edge = np.zeros(len(starts) + 1, np.int64)
                np.add.at(edge, np.maximum(anchor - period + 1, np.repeat(before[:-1], count)), 1)
                np.add.at(edge, anchor + 1, -1)
                near = np.cumsum(edge[:-1]) > 0
                row = np.repeat(np.arange(j - i), np.diff(before))
                at = np.flatnonzero(near)
                at = at[at + window <= before[row[at] + 1]]
                if not len(at):
                    continue
                row = row[at]
                lanes = [run_hashes(word_hashes(part, starts, ends, lane), window, lane)[at].view(np.int64) for lane in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[i + row]), pa.array(keys[i + row]), *map(pa.array, lanes), pa.array((at - before[row]).astype(np.int32))],
                    ["doc_id", "text_key", "h0", "h1", "pos"],
                )

    return run


def _strip(window: int):
    """Of rows (_row, _text, _spots, _copy) the kept words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            own, texts, spots, copies = (whole.column(whole.schema.get_field_index(n)) for n in ("_row", "_text", "_spots", "_copy"))
            for i, j in slices(column_buffers(texts)[1], SLICE_BYTES):
                kept, n_words, n_removed = [], [], []
                for text, spot, copy in zip(texts.slice(i, j - i).to_pylist(), spots.slice(i, j - i), copies.slice(i, j - i).to_pylist(), strict=True):
                    words = (text or "").encode().split()
                    gone = np.zeros(len(words) + 1, np.int64)
                    if copy and len(words) >= window:
                        gone[0] = 1
                    elif spot.is_valid and len(spot.values):
                        at = spot.values.to_numpy()
                        np.add.at(gone, at, 1)
                        np.add.at(gone, at + window, -1)
                    stay = np.cumsum(gone[:-1]) == 0
                    n_words.append(len(words))
                    n_removed.append(int(len(words) - stay.sum()))
                    kept.append(b" ".join([words[k] for k in np.flatnonzero(stay)] if n_removed[-1] else words).decode())
                yield pa.RecordBatch.from_arrays(
                    [own.slice(i, j - i), texts.slice(i, j - i), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                    ["_row", "_text", *OUTPUTS],
                )

    return run


def remove_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, and n_words, n_removed and kept_text (the kept words joined by one space)."""
    names = [c for c in docs.columns if c not in OUTPUTS]
    # the documents' own columns are one, so none of their names can clash
    own = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in names if c != text_col]).alias("_row")
    rows = docs.select(own, F.col(text_col).alias("_text"), F.col(id_col).cast("long").alias("_doc"), F.xxhash64(text_col).alias("_key"))
    keyed = rows.where("_doc IS NOT NULL AND _text IS NOT NULL")

    ids = keyed.select("_doc", "_key", F.xxhash64(F.lit(1), "_text").alias("_key2"))
    first = ids.groupBy("_key", "_key2").agg(F.min("_doc").alias("first"), F.max("_doc").alias("last"))
    copies = cut(ids.join(first.where("first < last"), ["_key", "_key2"]).where("_doc > first").select("_doc", "_key").distinct())

    anchors = keyed.select("_key", "_text").mapInArrow(_anchors(window), ANCHORS)
    shared = cut(anchors.groupBy("hash").agg(F.min("text_key").alias("least"), F.max("text_key").alias("most")).where("least < most").select("hash"))
    spots = anchors.join(shared, "hash").groupBy(F.col("text_key").alias("_key")).agg(F.collect_set("pos").alias("spots"))
    spots = cut(spots.join(first.groupBy("_key").agg(F.min("first").alias("_doc")), "_key").select("_doc", "_key", "spots"))
    # nominated texts are shuffled once and read twice
    near = cut(keyed.select("_doc", "_key", "_text").join(spots, ["_doc", "_key"]))

    windows = near.select("_doc", "_key", "_text", "spots").mapInArrow(_windows(window), WINDOWS)
    # a table of its own, so the join below can split a window that very many documents share
    smallest = cut(windows.groupBy("h0", "h1").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("h0", "h1", "first"))
    gone = windows.join(smallest, ["h0", "h1"]).where("doc_id > first").groupBy("doc_id", "text_key").agg(F.collect_set("pos").alias("_spots"))

    marks = cut(
        gone.select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), "_spots", F.lit(False).alias("_copy")).unionByName(
            copies.select("_doc", "_key", F.lit(None).cast("array<int>").alias("_spots"), F.lit(True).alias("_copy"))
        )
    )
    marked = rows.join(marks, ["_doc", "_key"], "left").select("_row", "_text", "_spots", "_copy")
    schema = T.StructType([marked.schema["_row"], marked.schema["_text"]]).add("n_words", "long").add("n_removed", "long").add("kept_text", "string")
    stripped = marked.mapInArrow(_strip(window), schema)
    return stripped.select(*[F.col("_text").alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in names], *OUTPUTS)


def kept_digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def removed_by_brute_force(rows: list[tuple[int, str | None]], window: int = 50) -> list[tuple[int, int, int, str]]:
    """The same over a small list of rows, by a dictionary of all windows: for tests."""
    first: dict[tuple, int] = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, words in split:
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            first[key] = min(d, first.get(key, d))
    out = []
    for d, words in split:
        stay = [True] * len(words)
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] < d:
                stay[i : i + window] = [False] * window
        kept = b" ".join(w for w, s in zip(words, stay, strict=True) if s)
        out.append((d, len(words), len(words) - sum(stay), hashlib.sha256(kept).hexdigest()))
    return out
