"""BPE encoding and decoding by batched numpy merge rounds.

The words that a slice has not met before lie in one flat array of symbols. A round
looks up neighbouring pairs by binary search over the sorted pair keys, takes each
word's lowest rank, and merges every occurrence of that pair from the left; words
without a pair that merges leave. Words of more than LONG_WORD bytes have rounds of
their own, in which only the pairs beside a merge are looked up again: a round merges
the lowest rank of all of them, and its places wait in a heap, so a word of millions of
letters costs n log n. Encoded words stay in caches of the worker that are bounded by
bytes; words that are long are not kept.

Merging all occurrences in one round equals merging one at a time, since each token
has one merge that makes it and is made before any merge that uses it; loading the
vocabulary checks both. A merge's new pairs so have higher ranks than its own.

Defined cases: a null text has no ids and decodes to an empty text, as an empty one; ids
that are null or not in the vocabulary are left out in decoding, a null list decodes to
an empty text; repeated rows are encoded each; other columns pass through, and columns
named like the outputs are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import column_buffers, slices

NO_RANK = np.int64(1) << 40
#: Bytes of a generation of the caches of words and of runs without white space, and of an entry beside its characters: they bound memory, not results.
WORD_BYTES, CHUNK_BYTES, ENTRY_BYTES = 16 << 20, 40 << 20, 200
#: Bytes of text, or characters of one text, that are split into words at a time.
SLICE_BYTES = 1 << 20
#: Bytes beyond which a word is merged by its own rounds, and characters beyond which it is not kept.
LONG_WORD, MOST_KEPT = 256, 64

#: Fixed values of the vocabulary's format: the pattern of words, the end of a word, the special tokens.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
WORD_END = "</w>"
#: White space of the pattern, and the characters that only Python's str.split() takes for it.
SPACES, NOT_SPACES = regex.compile(r"[\t-\r \x85\xa0  -     　]+"), regex.compile(r"[\x1c-\x1f]")


def byte_characters() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def merge_pairs(spec: dict) -> list[tuple[str, str]]:
    """The merges of a tokenizer file's model, by rank."""
    return [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]


class Merges:
    """The merges of a vocabulary as sorted pair keys, and rounds over flat arrays of symbols."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        rank_of = np.full(max(vocab.values()) + 1, -1, np.int64)
        rank_of[self.made] = np.arange(len(merges))
        if len(np.unique(self.made)) < len(self.made) or (np.maximum(rank_of[left], rank_of[right]) >= np.arange(len(merges))).any():
            raise ValueError("merge rounds need a vocabulary in which each token has one merge, made before its uses")
        keys = left << 32 | right
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, NO_RANK where it has none."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NO_RANK)

    def rounds(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge short words; symbols and their words (in order within each word) come back."""
        done_word, done_symbols = [], []
        while len(symbols):
            rank = np.append(np.where(word[:-1] == word[1:], self.rank(symbols[:-1], symbols[1:]), NO_RANK), NO_RANK)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            lowest = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, len(word)))
            active = np.repeat(lowest < NO_RANK, sizes)
            if not active.all():
                done_word.append(word[~active])
                done_symbols.append(symbols[~active])
            spots = np.flatnonzero(active & (rank == np.repeat(lowest, sizes)))
            spots = spots[self.second(np.diff(spots) != 1, len(spots))]
            symbols[spots] = self.made[rank[spots]]
            active[spots + 1] = False
            symbols, word = symbols[active], word[active]
        return np.concatenate(done_symbols or [symbols]), np.concatenate(done_word or [word])

    @staticmethod
    def second(apart: np.ndarray, n: int) -> np.ndarray:
        """Of overlapping occurrences (a run of one symbol) each second one from the left: a mask."""
        begins = np.append(True, apart)[:n]
        place = np.arange(n)
        return (place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 0

    def long_rounds(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge long words: a round merges the lowest rank that is left, and looks up only the pairs beside it."""
        n = len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.append(np.flatnonzero(word[1:] != word[:-1]), n - 1)
        after[ends] = n
        before[np.append(0, ends[:-1] + 1)] = -1
        rank = np.full(n + 1, NO_RANK)
        rank[:-1] = np.append(np.where(word[:-1] == word[1:], self.rank(symbols[:-1], symbols[1:]), NO_RANK), NO_RANK)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def put(places: np.ndarray) -> None:
            places = places[rank[places] < NO_RANK]
            if not len(places):
                return
            if len(places) == 1:
                groups = [places]
            else:
                places = places[np.argsort(rank[places], kind="stable")]
                groups = np.split(places, np.flatnonzero(np.diff(rank[places])) + 1)
            for group in groups:
                r = int(rank[group[0]])
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(heap, r)
                waiting[r].append(group)

        put(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            spots = np.concatenate(waiting.pop(r))
            spots = np.unique(spots[rank[spots] == r])  # others were merged with a neighbour since
            if not len(spots):
                continue
            spots = spots[self.second(after[spots[:-1]] != spots[1:], len(spots))]
            gone = after[spots]
            symbols[spots] = self.made[r]
            symbols[gone] = -1
            rank[gone] = NO_RANK
            following = after[gone]
            after[spots] = following
            before[following[following < n]] = spots[following < n]
            touched = np.concatenate([spots, before[spots][before[spots] >= 0]])
            right = after[touched]
            inside = right < n
            rank[touched] = NO_RANK
            touched, right = touched[inside], right[inside]
            rank[touched] = self.rank(symbols[touched], symbols[right])
            put(np.unique(touched))
        left = symbols >= 0
        return symbols[left], word[left]


class WordBpe:
    """An encoder for a BPE vocabulary with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.merges = Merges(vocab, merge_pairs(spec))
        characters = byte_characters()
        self.inner = np.array([vocab.get(characters[b], -1) for b in range(256)], np.int64)
        self.final = np.array([vocab.get(characters[b] + WORD_END, -1) for b in range(256)], np.int64)
        if min(self.inner.min(), self.final.min()) < 0:
            raise ValueError("the vocabulary lacks single bytes")
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.words, self.chunks = Cache(WORD_BYTES), Cache(CHUNK_BYTES)

    def merge_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as 32-bit integers in bytes."""
        raw = [w.encode() for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols, word = self.inner[data], np.repeat(np.arange(len(raw)), lengths)
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.final[data[ends]]
        long = np.repeat(lengths > LONG_WORD, lengths)
        parts = [self.merges.rounds(symbols[~long], word[~long])]
        if long.any():
            parts.append(self.merges.long_rounds(symbols[long], word[long]))
        symbols, word = (np.concatenate(p) for p in zip(*parts, strict=True))
        order = np.argsort(word, kind="stable")
        flat = symbols[order].astype("<i4").tobytes()
        bounds = (np.append(0, np.cumsum(np.bincount(word, minlength=len(raw)))) * 4).tolist()
        return [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def words_in(self, chunk: str) -> list[str | int]:
        """The words of a run without white space, lower-cased, and the ids of special tokens in it."""
        if chunk.isascii() and chunk.isalpha():
            return [chunk.lower()]
        own: list[str | int] = []
        for part in self.split_special.split(chunk) if "<|" in chunk else (chunk,):
            if part in self.special:
                own.append(self.special[part])
            elif part:
                part = part if part.isascii() else unicodedata.normalize("NFC", part)
                # case is mapped by character: no special final sigma
                part = "".join(c.lower() for c in part) if "Σ" in part else part.lower()
                own += [part] if part.isalpha() else WORD.findall(part)
        return own

    def learn(self, chunks: list[str]) -> dict[str, bytes]:
        """The ids of runs without white space, from the words' cache and from merges."""
        pieces = list(map(self.words_in, chunks))
        wanted = {w for own in pieces for w in own if isinstance(w, str)}
        known = self.words.known(wanted)
        words = list(wanted - known.keys())
        if words:
            new = dict(zip(words, self.merge_words(words), strict=True))
            self.words.keep(new)
            known |= new
        return {c: known[p[0]] if len(p) == 1 and isinstance(p[0], str) else b"".join([known[w] if isinstance(w, str) else np.int32(w).tobytes() for w in p]) for c, p in zip(chunks, pieces, strict=True)}

    def encode_part(self, texts: list[str]) -> list[bytes]:
        parts = [SPACES.split(t) if NOT_SPACES.search(t) else t.split() for t in texts]
        wanted: set[str] = set()
        wanted.update(*parts)
        known = self.chunks.known(wanted)
        new = list(wanted - known.keys())
        if new:
            learned = self.learn(new)
            self.chunks.keep(learned)
            known |= learned
        get = known.__getitem__
        return [b"".join(map(get, p)) for p in parts]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as 32-bit integers in bytes; a long text goes in parts, cut at white space."""
        if all(len(t) <= SLICE_BYTES for t in texts):
            return self.encode_part(texts)
        return [b"".join(self.encode_part([part])[0] for part in cut_at_spaces(t, SLICE_BYTES)) for t in texts]


def cut_at_spaces(text: str, size: int) -> Iterator[str]:
    """Parts of about ``size`` characters; a longer run without a space stays whole."""
    at = 0
    while at < len(text):
        end = text.find(" ", at + size)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


class Cache:
    """Ids of short strings in two generations; the older one goes when the younger takes more than its bytes."""

    def __init__(self, most_bytes: int):
        self.most_bytes = most_bytes
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0

    def known(self, wanted: set[str]) -> dict[str, bytes]:
        """Those of ``wanted`` that are held; what is found among the old is young again."""
        out = {k: self.young[k] for k in wanted & self.young.keys()}
        again = {k: self.old[k] for k in (wanted - out.keys()) & self.old.keys()}
        if again:
            out |= again
            self.keep(again)
        return out

    def keep(self, new: dict[str, bytes]) -> None:
        short = {k: v for k, v in new.items() if len(k) <= MOST_KEPT}
        self.size += sum(map(len, short)) + sum(map(len, short.values())) + ENTRY_BYTES * len(short)
        self.young |= short
        if self.size > self.most_bytes:
            self.young, self.old, self.size = {}, self.young, 0


@lru_cache(maxsize=2)
def encoder(path: str) -> WordBpe:
    return WordBpe(path)


@lru_cache(maxsize=2)
def token_table(path: str) -> dict[int, str]:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}


def _with(batch: pa.RecordBatch, names: list[str], name: str, column: pa.Array) -> pa.RecordBatch:
    columns = [batch.column(i) for i, n in enumerate(batch.schema.names) if n in names]
    return pa.RecordBatch.from_arrays([*columns, column], [*names, name])


def _schema(df: DataFrame, names: list[str], field: T.StructField) -> T.StructType:
    return T.StructType([*[f for f in df.schema.fields if f.name in names], field])


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Replace nothing, add ``ids_col`` (array of int) with the text's token ids."""
    names = [c for c in df.columns if c != ids_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for whole in batches:
            _, offsets = column_buffers(whole.column(whole.schema.get_field_index(text_col)))
            for i, j in slices(offsets, SLICE_BYTES):
                batch = whole.slice(i, j - i)
                ids = bpe.encode([t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()])
                bounds = np.append(0, np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))) // 4
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())
                yield _with(batch, names, ids_col, pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), values))

    return df.mapInArrow(run, _schema(df, names, T.StructField(ids_col, T.ArrayType(T.IntegerType()))))


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Add ``text_col`` with the tokens joined by one space, which is how this vocabulary (no decoder) decodes."""
    names = [c for c in df.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_table(path)
        get = table.__getitem__
        for whole in batches:
            column = whole.column(whole.schema.get_field_index(ids_col))
            lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            offsets = np.append(0, np.cumsum(lengths)) * 4
            for i, j in slices(offsets, SLICE_BYTES):
                batch = whole.slice(i, j - i)
                texts = []
                for ids in column.slice(i, j - i):
                    values = ids.values
                    if values is None or not len(values):
                        texts.append("")
                        continue
                    values = values.to_pylist() if values.null_count else values.to_numpy().tolist()
                    try:
                        texts.append(" ".join(map(get, values)))
                    except KeyError:
                        texts.append(" ".join(table[v] for v in values if v is not None and v in table))
                yield _with(batch, names, text_col, pa.array(texts, pa.string()))

    return df.mapInArrow(run, _schema(df, names, T.StructField(text_col, T.StringType())))


def joined_ids(ids: str) -> Column:
    """The decimal ids joined by one space."""
    return F.concat_ws(" ", F.col(ids).cast("array<string>"))
