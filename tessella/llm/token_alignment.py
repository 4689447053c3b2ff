"""Alignment of two tokenizers through a dictionary of token groups.

A text is cut where tokens of both tokenizers end at the same byte; what lies between two
cuts is a group, and each A token of a group is linked with each B token of it. Groups
repeat within and across documents, so they are interned: a document keeps its distinct
groups' keys and how often it has each, and a dictionary has each distinct group's tokens
once. Links are expanded once for each distinct group. A pair of ids is linked in as many
documents as hold a group with it, less what documents count twice that hold several
such groups (each document tells these itself). The dictionary's sums over links then go
back to documents by the groups' keys, times their frequencies.

Workers find groups in whole batches of texts: ends of tokens are sums of their bytes'
numbers, cuts are the ends that both have, and a group's key is a 128-bit sum of its mixed
tokens. Both tokenizers always end a token before a space that follows something else, so
very long texts are tokenized in parts.

Keys that hold a large share of a join's rows are told by their counts: of keys with more
than a 262,144th of the rows there are 262,144 at most, and these are broadcast; the others are
shuffled.

Defined cases: null and empty texts, and texts whose tokens of either tokenizer do not add
up to the space and the text, have no tokens: zeros, and an empty string of groups; rows
that repeat a doc_id are documents each, as are rows without one; strings of special
tokens are plain text; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import packing
from tessella.llm.common import column_buffers, cut, slices
from tessella.llm.textscan import U, mix

SLICE_BYTES = 1 << 20
#: Characters of a text that are tokenized at a time, and keys that a task remembers to have told.
PART, MOST_TOLD = 1 << 20, 1_000_000
#: A key with more than this part of a join's rows is broadcast; there are as many of them at most.
SHARES = 1 << 18
#: Links of a group beyond which its ids are made distinct before they are paired.
MANY_LINKS = 1 << 20
#: A space that does not follow white space: both tokenizers begin a token there.
BREAK = re.compile(rf"(?<=[^{packing.WHITE}]) ")
SPACE_MARK = "▁"
LANES = (U(0x9216D5D98979FB1B), U(0xD1310BA698DFB5AC))

TOLD = (
    "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, used array<struct<k0:long,k1:long,times:int>>, "
    "learned array<struct<k0:long,k1:long,a:array<int>,b:array<int>>>, again array<struct<a:int,b:int,times:int>>"
)


def parts_of(text: str) -> list[str]:
    """A space and the text, in parts that begin with a space where the text breaks."""
    if len(text) <= PART:
        return [" " + text]
    out, at = [], 0
    while at < len(text):
        found = BREAK.search(text, at + PART)
        end = found.start() if found else len(text)
        out.append(text[at:end] if at else " " + text[:end])
        at = end
    return out


class Aligner:
    """Groups of texts by a byte-level tokenizer file (A) and a sentencepiece model (B)."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a = packing.encoder(a_path)
        a_bytes = {i: self.a.fast.decode_single_token_bytes(i) for i in self.a.fast._mergeable_ranks.values()}
        self.a_sizes = np.zeros(max(a_bytes) + 1, np.int64)
        for i, raw in a_bytes.items():
            self.a_sizes[i] = len(raw)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces):
            raise ValueError("a piece goes on beyond a space: parts cannot be told apart")
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.b_sizes = np.array([len(x) for x in b_bytes], np.int64)
        self.b_starts = np.cumsum(self.b_sizes) - self.b_sizes
        self.b_flat = np.frombuffer(b"".join(b_bytes), np.uint8)
        self.space = self.b.piece_to_id(SPACE_MARK)
        #: Ids as text, with what follows them: within a group, and at the end of its A or its B tokens.
        self.written = [f"{i}{mark}" for sizes, marks in ((self.a_sizes, ",|"), (self.b_sizes, ",;")) for i in range(len(sizes)) for mark in marks]

    def tokens(self, text: str) -> tuple[list[int], list[int]]:
        a: list[int] = []
        b: list[int] = []
        for part in parts_of(text):
            raw = np.frombuffer(part.encode(), np.uint8)
            if packing.long_runs(raw, np.array([0, len(raw)])):
                a += np.frombuffer(self.a.encode_by_word(part, special=False), "<u4").tolist()
            else:
                a += self.a.fast.encode_ordinary(part)
            # a space alone is the model's own prefix, which an empty text does not get
            b += self.b.encode(part[1:]) if len(part) > 1 else [self.space]
        return a, b

    def align(self, texts: list[str | None]) -> Groups:
        """The groups of texts; a text without tokens has none."""
        ids = [self.tokens(t) if t else ([], []) for t in texts]
        raw = [(" " + t).encode() if t else b"" for t in texts]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        a, b = (np.concatenate([np.zeros(0, np.int64), *(np.array(own[k], np.int64) for own in ids)]) for k in (0, 1))
        a_doc, b_doc = (np.repeat(np.arange(len(ids)), [len(own[k]) for own in ids]) for k in (0, 1))
        # texts whose tokens don't add up to them go
        a_whole, b_whole = (np.bincount(doc, own, minlength=len(ids)).astype(np.int64) for doc, own in ((a_doc, self.a_sizes[a]), (b_doc, self.b_sizes[b])))
        good = (a_whole == sizes) & (b_whole == sizes)
        own = b[good[b_doc]]
        lengths = self.b_sizes[own]
        at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(self.b_starts[own], lengths)
        differs = self.b_flat[at] != np.frombuffer(b"".join(r for r, ok in zip(raw, good.tolist(), strict=True) if ok), np.uint8)
        if differs.any():
            good[np.repeat(np.flatnonzero(good), sizes[good])[differs]] = False
        keep_a, keep_b = good[a_doc], good[b_doc]
        return Groups(self, a[keep_a], b[keep_b], a_doc[keep_a], b_doc[keep_b], len(texts))


class Groups:
    """The groups of a batch of texts, as ranges of flat arrays of tokens."""

    def __init__(self, own: Aligner, a: np.ndarray, b: np.ndarray, a_doc: np.ndarray, b_doc: np.ndarray, n: int):
        self.own, self.a, self.b, self.n = own, a, b, n
        a_ends, b_ends = np.cumsum(own.a_sizes[a]), np.cumsum(own.b_sizes[b])
        at = np.searchsorted(b_ends, a_ends)
        common = np.flatnonzero(b_ends[np.minimum(at, len(b_ends) - 1)] == a_ends) if len(a) else np.zeros(0, np.int64)
        a_upto, b_upto = common + 1, at[common] + 1
        self.a_from, self.b_from = np.append(0, a_upto)[:-1], np.append(0, b_upto)[:-1]
        self.n_a, self.n_b = a_upto - self.a_from, b_upto - self.b_from
        self.doc = a_doc[self.a_from] if len(common) else common
        self.doc_a, self.doc_b = np.bincount(a_doc, minlength=n), np.bincount(b_doc, minlength=n)
        self.a_group, self.b_group = np.repeat(np.arange(len(common)), self.n_a), np.repeat(np.arange(len(common)), self.n_b)

    def counts(self) -> list[np.ndarray]:
        links = np.zeros(self.n, np.int64)
        np.add.at(links, self.doc, self.n_a * self.n_b)
        return [self.doc_a, self.doc_b, np.bincount(self.doc, minlength=self.n), links]

    def texts(self) -> list[str]:
        """Each text's groups: ids joined by commas, A and B by a bar, groups by semicolons."""
        a_last, b_last = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        a_last[self.a_from + self.n_a - 1] = 1
        b_last[self.b_from + self.n_b - 1] = 1
        order = np.empty(len(self.a) + len(self.b), np.int64)
        order[np.arange(len(self.a)) + self.b_from[self.a_group]] = 2 * self.a + a_last
        order[np.arange(len(self.b)) + (self.a_from + self.n_a)[self.b_group]] = 2 * (self.b + len(self.own.a_sizes)) + b_last
        flat = list(map(self.own.written.__getitem__, order.tolist()))
        ends = np.cumsum(self.doc_a + self.doc_b).tolist()
        return ["".join(flat[i:j])[:-1] for i, j in zip([0, *ends[:-1]], ends, strict=True)]

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each group's tokens and their places."""
        out = []
        for lane in LANES:
            h = np.zeros(len(self.doc), U)
            for side, (ids, group, first) in enumerate(((self.a, self.a_group, self.a_from), (self.b, self.b_group, self.b_from))):
                place = (np.arange(len(ids)) - first[group]).astype(U)
                value = mix(mix(ids.astype(U) * U(2) + U(side) + lane) + place * U(0x9E3779B97F4A7C15))
                if len(ids):
                    h += np.add.reduceat(value, first)
            out.append(mix(h ^ lane).view(np.int64))
        return out[0], out[1]

    def links(self, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All links of some groups: the group's place among them, a, b; of a group with very many, each pair once."""
        n_a, n_b = self.n_a[groups], self.n_b[groups]
        few = n_a * n_b <= MANY_LINKS
        own = np.flatnonzero(few)
        many = n_a[own] * n_b[own]
        owner = np.repeat(own, many)
        off = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        a, b = self.a[self.a_from[groups[owner]] + off // n_b[owner]], self.b[self.b_from[groups[owner]] + off % n_b[owner]]
        for k in np.flatnonzero(~few).tolist():
            g = groups[k]
            x, y = np.unique(self.a[self.a_from[g] : self.a_from[g] + n_a[k]]), np.unique(self.b[self.b_from[g] : self.b_from[g] + n_b[k]])
            owner, a, b = np.append(owner, np.full(len(x) * len(y), k)), np.append(a, np.repeat(x, len(y))), np.append(b, np.tile(y, len(x)))
        return owner, a, b


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _lists(owner: np.ndarray, n: int, **columns: pa.Array) -> pa.Array:
    """A list of structs for each of ``n`` rows; ``owner`` rises."""
    bounds = np.append(0, np.cumsum(np.bincount(owner, minlength=n))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays(list(columns.values()), list(columns)))


def _ids(flat: np.ndarray, first: np.ndarray, count: np.ndarray) -> pa.Array:
    """Ranges of an array as lists."""
    at = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)).astype(np.int32)), pa.array(flat[at], pa.int32()))


def _batch(row: int, doc_ids: pa.Array, found: Groups, told: set[int], kept: Callable[[str], str] = str) -> pa.RecordBatch:
    n = found.n
    k0, k1 = found.keys()
    # distinct groups of each text, with how often it has them
    order = np.lexsort((k1, k0, found.doc))
    d, x, y = found.doc[order], k0[order], k1[order]
    new = np.append(True, (d[1:] != d[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]))[: len(d)]
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(d)))
    group, d = order[first], d[first]
    # links that several distinct groups of a text hold
    owner, a, b = found.links(group)
    pair = (d[owner] * len(found.own.a_sizes) + a) * len(found.own.b_sizes) + b
    by = np.lexsort((owner, pair))
    pair, owner = pair[by], owner[by]
    once = np.append(True, (pair[1:] != pair[:-1]) | (owner[1:] != owner[:-1]))[: len(pair)]
    pair, held = np.unique(pair[once], return_counts=True)
    pair, held = pair[held > 1], held[held > 1] - 1
    again, a = np.divmod(pair // len(found.own.b_sizes), len(found.own.a_sizes))
    # groups that this task has not told yet go with the batch's first row
    _, some = np.unique(k0[group], return_index=True)
    some = some[np.array([k not in told for k in k0[group[some]].tolist()], bool)] if len(some) else some
    learned = group[some]
    if len(told) > MOST_TOLD:
        told.clear()
    told.update(k0[learned].tolist())
    columns = [pa.array(np.arange(row, row + n)), doc_ids, *map(pa.array, found.counts()), pa.array(list(map(kept, found.texts())), pa.string())]
    columns.append(_lists(d, n, k0=pa.array(k0[group]), k1=pa.array(k1[group]), times=pa.array(times, pa.int32())))
    columns.append(_lists(np.zeros(len(learned), np.int64), n, k0=pa.array(k0[learned]), k1=pa.array(k1[learned]), a=_ids(found.a, found.a_from[learned], found.n_a[learned]), b=_ids(found.b, found.b_from[learned], found.n_b[learned])))
    columns.append(_lists(again, n, a=pa.array(a, pa.int32()), b=pa.array(pair % len(found.own.b_sizes), pa.int32()), times=pa.array(held, pa.int32())))
    return pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "used", "learned", "again"])


def _told(a_path: str, b_path: str, kept: Callable[[str], str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, row, told = aligner(a_path, b_path), TaskContext.get().partitionId() << 40, set()
        for batch in batches:
            _, offsets = column_buffers(batch.column(1))
            for i, j in slices(offsets, SLICE_BYTES):
                yield _batch(row, batch.column(0).slice(i, j - i), own.align(batch.column(1).slice(i, j - i).to_pylist()), told, kept)
                row += j - i

    return run


def by_share(rows: DataFrame, values: DataFrame, on: list[str], weight: str) -> DataFrame:
    """``rows`` with the columns of ``values``, which has a row for each key and in ``weight`` the number of rows that have it."""
    total = values.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    heavy = F.col(weight) * F.lit(SHARES) >= F.lit(total)  # the weights add up to the total, so at most SHARES keys are heavy
    often = values.where(heavy).drop(weight)
    rest = rows.join(F.broadcast(often.select(*on)), on, "left_anti").join(values.where(~heavy).drop(weight), on)
    return rows.join(F.broadcast(often), on).unionByName(rest)


def tokenized(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", kept: Callable[[str], str] = str) -> DataFrame:
    """A row for each document, with its groups' keys and the groups that its task met first; stored, as rows are numbered by task."""
    return cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_told(a_path, b_path, kept), TOLD))


def _uses(told: DataFrame) -> DataFrame:
    return told.select("row", F.explode("used").alias("u")).select("row", "u.k0", "u.k1", "u.times")


def group_dictionary(told: DataFrame) -> DataFrame:
    """Each distinct group once: k0, k1, a, b (its ids), documents (how many hold it)."""
    learned = told.select(F.explode("learned").alias("g")).select("g.*")
    distinct = learned.groupBy("k0", "k1").agg(F.any_value("a").alias("a"), F.any_value("b").alias("b"))
    return cut(distinct.join(_uses(told).groupBy("k0", "k1").agg(F.count(F.lit(1)).alias("documents")), ["k0", "k1"]))


def link_counts(told: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Each linked pair of ids: a, b, documents (how many hold it linked), groups (distinct ones with it, each as often as it is linked in it), best (whether no other b has more for this a)."""
    once = dictionary.select("documents", F.explode(F.array_distinct("a")).alias("a"), "b").select("documents", "a", F.explode(F.array_distinct("b")).alias("b"))
    twice = told.select(F.explode("again").alias("x")).select((-F.col("x.times")).cast("long").alias("documents"), "x.a", "x.b")
    documents = once.unionByName(twice).groupBy("a", "b").agg(F.sum("documents").alias("documents"))
    groups = _links(dictionary).groupBy("a", "b").agg(F.count(F.lit(1)).alias("groups"))
    pairs = cut(documents.join(groups, ["a", "b"]))
    highest = pairs.groupBy("a").agg(F.max("documents").alias("highest"))  # a row for each id of A's vocabulary at most
    return pairs.join(F.broadcast(highest), "a").select("a", "b", "documents", "groups", (F.col("documents") == F.col("highest")).alias("best"))


def _links(dictionary: DataFrame) -> DataFrame:
    """All links of each distinct group."""
    return dictionary.select("k0", "k1", F.explode("a").alias("a"), "b").select("k0", "k1", "a", F.explode("b").alias("b"))


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", kept: Callable[[str], str] = str) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups (``a1,a2|b1;a3|b2,b3``: ids in order).

    ``kept`` tells what is kept of a text's groups, which are several times its length; all of them where it isn't given.
    """
    told = tokenized(docs, a_path, b_path, id_col, text_col, kept)
    dictionary = group_dictionary(told)
    counts = cut(link_counts(told, dictionary))
    valued = by_share(_links(dictionary), counts.withColumnRenamed("documents", "held"), ["a", "b"], "groups")
    sums = valued.groupBy("k0", "k1").agg(F.count_if("best").alias("best"), F.sum("held").alias("held"))
    sums = cut(sums.join(dictionary.select("k0", "k1", "documents"), ["k0", "k1"]))
    back = by_share(_uses(told), sums, ["k0", "k1"], "documents")
    found = back.groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("held")).alias("count_sum"))
    rows = told.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups").join(found, "row", "left")
    zero = F.lit(0).cast("long")
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups")
