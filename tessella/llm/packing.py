"""Bounded-space online packing of token sequences into windows of fixed length.

Each partition keeps a fixed number of open windows. A document's ids are cut into
full windows and a rest; the rest goes to the open window it fills best. When none has
room, the fullest is emitted and a new one opened. The windows that are still open at
a partition's end, of which there are so many per partition at most, are merged in
groups of partitions, and only their pieces move.

Texts with a run of more than LONG_RUN bytes of white space (of any kinds the pattern
knows, mixed as they may be), or without any, are split into words here, one at a time,
and their long words are merged in numpy rounds: the library that encodes the others
fails on such runs, or takes the square of their length.

Defined cases: a null text has no ids but the closing one; an empty table gives an
empty result; a row without id is packed too (its pieces have a null doc_id); repeated
rows are packed each; other columns are left out.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.bpe import Merges, byte_characters, merge_pairs
from tessella.llm.common import column_buffers, cut, slices
from tessella.llm.textscan import SPACE

SLICE_BYTES = 4 << 20
#: Bytes of one run beyond which a text is split into words here, and of a word beyond which it is merged here.
LONG_RUN, LONG_WORD = 4096, 512
#: The pattern by which byte-level vocabularies of this kind split text, and the same with its white space spelled out.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")

#: The white space beyond ASCII, as the bytes of UTF-8 read as one number.
WIDE_SPACES = np.array(sorted(int.from_bytes(chr(c).encode()) for c in [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

PIECES = "doc_id long, doc_tokens long, start long, ids binary, window long, offset long, open boolean"


class ByteBpe:
    """Ids of a byte-level BPE tokenizer file, by tiktoken from the file's own vocabulary.

    In such a file a token's id grows with its merge's rank, which loading checks, so
    ids serve as ranks. Texts that hold a special token's string go to the tokenizers
    library itself.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # read when the library loads
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pieces, model = spec["pre_tokenizer"], spec["model"]
        plain = pieces["type"] == "ByteLevel" and pieces.get("use_regex", True) and not pieces["add_prefix_space"] and not spec["normalizer"]
        merged = [model["vocab"]["".join(m)] for m in merge_pairs(spec)]
        if not plain or model.get("ignore_merges") or merged != sorted(merged) or merged and merged[0] < 256:
            raise ValueError("not a plain byte-level vocabulary in the order of its merges")
        characters = byte_characters()
        byte = {c: b for b, c in characters.items()}
        ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in self.special}
        self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.merges = Merges(model["vocab"], merge_pairs(spec))
        self.byte_ids = np.array([model["vocab"][characters[b]] for b in range(256)], np.int64)
        self.special_ids = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}

    def encode_by_word(self, text: str, special: bool = True) -> bytes:
        """The ids of a text with long runs; its short words are met once each. Without ``special``, strings of special tokens are plain text."""
        out: list[bytes] = []
        met: dict[str, bytes] = {}
        parts = regex.split("(" + "|".join(map(regex.escape, self.special)) + ")", text) if special and any(s in text for s in self.special) else [text]
        for part in parts:
            if special and part in self.special_ids:
                out.append(np.uint32(self.special_ids[part]).tobytes())
                continue
            for match in WORDS.finditer(part):
                word = match.group()
                if len(word) > LONG_WORD:
                    symbols = self.byte_ids[np.frombuffer(word.encode(), np.uint8)]
                    out.append(self.merges.long_rounds(symbols, np.zeros(len(symbols), np.int64))[0].astype("<u4").tobytes())
                    continue
                if word not in met:
                    if len(met) >= 1 << 16:
                        met.clear()
                    met[word] = np.array(self.fast.encode_ordinary(word), "<u4").tobytes()
                out.append(met[word])
        return b"".join(out)

    def encode(self, texts: list[str], long: set[int]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit integers; ``long`` has the places of texts with long runs."""
        out = []
        for k, t in enumerate(texts):
            if k in long:
                out.append(self.encode_by_word(t))
            elif any(s in t for s in self.special):
                out.append(np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes())
            else:
                out.append(np.array(self.fast.encode_ordinary(t), "<u4").tobytes())
        return out


def white(data: np.ndarray) -> np.ndarray:
    """Whether each byte of a text in UTF-8 is of a character that the pattern takes for white space."""
    out = SPACE[data]
    lead = np.flatnonzero(data >= 0xC2)
    for width, first in ((2, (0xC2, 0xC2)), (3, (0xE1, 0xE3))):
        at = lead[(data[lead] >= first[0]) & (data[lead] <= first[1]) & (lead + width <= len(data))]
        code = np.zeros(len(at), np.int64)
        for k in range(width):
            code = code << 8 | data[at + k]
        at = at[np.isin(code, WIDE_SPACES)]
        for k in range(width):
            out[at + k] = True
    return out


def long_runs(data: np.ndarray, offsets: np.ndarray, most: int = LONG_RUN) -> set[int]:
    """The rows that hold more than ``most`` bytes in a row of white space, or without any."""
    rows = np.flatnonzero(np.diff(offsets) > most)
    out = set()
    for r in rows.tolist():
        space = white(data[offsets[r] : offsets[r + 1]])
        edges = np.concatenate([[0], np.flatnonzero(space[1:] != space[:-1]) + 1, [len(space)]])
        if np.diff(edges).max() > most:
            out.add(r)
    return out


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteBpe:
    return ByteBpe(path)


class Windows:
    """The open windows of one partition; pieces leave when their window closes."""

    def __init__(self, size: int, open_windows: int, first: int):
        self.size, self.limit, self.next = size, open_windows, first
        self.free = np.zeros(0, np.int64)
        self.held: list[list[tuple]] = []
        self.out: list[tuple] = []

    def close(self, k: int, still_open: bool = False) -> None:
        offset = 0
        for doc_id, doc_tokens, start, ids in self.held[k]:
            self.out.append((doc_id, doc_tokens, start, ids, self.next, offset, still_open))
            offset += len(ids) // 4
        self.next += 1

    def remove(self, k: int) -> None:
        self.close(k)
        del self.held[k]
        self.free = np.delete(self.free, k)

    def place(self, piece: tuple) -> None:
        """Put a piece into the best fitting window."""
        need = len(piece[3]) // 4
        room = np.where(self.free >= need, self.free, np.iinfo(np.int64).max)
        k = int(room.argmin()) if len(room) else -1
        if k < 0 or room[k] == np.iinfo(np.int64).max:
            if len(self.held) >= self.limit:
                self.remove(int(self.free.argmin()))
            self.held.append([])
            self.free = np.append(self.free, self.size)
            k = len(self.held) - 1
        self.held[k].append(piece)
        self.free[k] -= need
        if self.free[k] == 0:
            self.remove(k)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total, step = len(ids) // 4, self.size * 4
        for at in range(0, len(ids) - len(ids) % step, step):
            self.out.append((doc_id, total, at // 4, ids[at : at + step], self.next, 0, False))
            self.next += 1
        if rest := len(ids) % step:
            self.place((doc_id, total, (len(ids) - rest) // 4, ids[-rest:]))

    def finish(self, still_open: bool) -> None:
        for k in range(len(self.held)):
            self.close(k, still_open)
        self.held, self.free = [], self.free[:0]

    def batch(self) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_())
        names = [x.split()[0] for x in PIECES.split(", ")]
        columns = list(zip(*self.out, strict=True)) if self.out else [()] * len(kinds)
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def pack(df: DataFrame, path: str, end_id: int, size: int = 2048, open_windows: int = 64, merged_partitions: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of sequences: doc_id, doc_tokens, start, ids (little-endian 32-bit integers), sequence_id, offset.

    ``end_id`` closes each document. Memory: ``open_windows`` windows in a task,
    ``open_windows * merged_partitions`` in a merging task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = encoder(path), np.uint32(end_id).tobytes()
        windows = Windows(size, open_windows, TaskContext.get().partitionId() << 40)
        for whole in batches:
            data, offsets = column_buffers(whole.column(1))
            for i, j in slices(offsets, SLICE_BYTES):
                ids = bpe.encode([t or "" for t in whole.column(1).slice(i, j - i).to_pylist()], long_runs(data, offsets[i : j + 1]))
                for doc_id, own in zip(whole.column(0).slice(i, j - i).to_pylist(), ids, strict=True):
                    windows.add(doc_id, own + end)
                yield windows.batch()
        windows.finish(still_open=True)
        yield windows.batch()

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by([("window", "ascending"), ("offset", "ascending")])
        windows = Windows(size, open_windows, (1 << 62) | int(table.column("window")[0].as_py()))
        pieces = [(r["doc_id"], r["doc_tokens"], r["start"], r["ids"]) for r in table.to_pylist()]
        windows.limit = len(pieces)
        for piece in sorted(pieces, key=lambda p: -len(p[3])):  # the longest first
            windows.place(piece)
        windows.finish(still_open=False)
        return pa.Table.from_batches([windows.batch()])

    placed = cut(df.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, PIECES))
    group = F.shiftright(F.shiftright("window", 40), merged_partitions.bit_length() - 1)
    merged = placed.where("open").groupBy(group.alias("group")).applyInArrow(merge, PIECES)
    return placed.where("NOT open").unionByName(merged).select("doc_id", "doc_tokens", "start", "ids", F.col("window").alias("sequence_id"), "offset")
