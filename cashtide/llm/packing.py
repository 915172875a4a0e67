"""Packing documents into fixed windows: overlong ones are cut, the rest go best-fit decreasing."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, END_ID, SPECIAL, SPECIAL_ID = 2048, 1, "<|endoftext|>", 50256
#: Windows that a task packs at once at most: bounds its memory; leftovers of a block move on to the next.
BLOCK_WINDOWS = 4096
#: The vocabulary's own pre-tokenizer (fixed value), and the same without the look-ahead, which changes
#: nothing where no two white-space characters are adjacent and is faster.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
_PAIR = re.compile(r"\s\s")


class BestFit:
    """Open windows by remaining capacity, with a segment tree over the capacities 0..size.

    Leaf c counts the open windows with c left; an inner node holds the sum below it. The tightest window that
    takes n tokens is one at the smallest non-empty leaf at or above n, found by one walk down the tree.
    """

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def _add(self, capacity: int, by: int) -> None:
        i = capacity + self.leaves
        while i:
            self.tree[i] += by
            i >>= 1

    def put(self, window: int, capacity: int) -> None:
        self.open[capacity].append(window)
        self._add(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(window, its capacity) of the tightest open window with at least `need` left, removed; None if none."""
        i = need + self.leaves
        if not self.tree[i]:
            while i > 1 and (i & 1 or not self.tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.tree[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        self._add(capacity, -1)
        return self.open[capacity].pop(), capacity


def best_fit_decreasing(lengths: np.ndarray, size: int = WINDOW) -> list[list[int]]:
    """Windows as lists of indexes into `lengths` (each 1..size), longest first; ties in index order."""
    fit, windows = BestFit(size), []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        got = fit.take(n)
        if got is None:
            got = (len(windows), size)
            windows.append([])
        windows[got[0]].append(i)
        if got[1] > n:
            fit.put(got[0], got[1] - n)
    return windows


class Tokenizer:
    """Token ids of whole texts by the byte-level BPE vocabulary, as the `tokenizers` library gives them."""

    def __init__(self, ranks_path: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.exact = tiktoken.Encoding("exact", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.plain = tiktoken.Encoding("plain", pat_str=PLAIN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        parts = text.split(SPECIAL) if SPECIAL in text else (text,)
        out: list[int] = []
        for k, part in enumerate(parts):
            if k:
                out.append(SPECIAL_ID)
            out += (self.exact if _PAIR.search(part) else self.plain).encode_ordinary(part)
        return out


def vocabulary_path() -> str:
    """Place of the vocabulary as ranks, the same as byte_bpe_50k.json; found on each executor."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, size: int = WINDOW, block_windows: int = BLOCK_WINDOWS, ranks_path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document's tokens end with id 1. Full windows are cut from documents longer than `size`; what is left over
    and the short documents are packed best-fit decreasing. Each task packs what it reads, in blocks of about
    `block_windows` windows, so nothing is shuffled and memory is bounded; windows of a block that are not yet
    nearly full are opened again in the next. Only a task's last windows can stay loose. Sequence ids hold the
    partition in their upper bits, so they are unique and a rerun of a lost task gives the same.

    Null or empty text: the single id 1. Repeated rows are packed as often as they occur. Empty table: empty
    result. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(ranks_path or vocabulary_path())
        sequence = TaskContext.get().partitionId() << 36
        rows: list[tuple] = []
        loose: list[tuple] = []
        held = 0

        def close(last: bool) -> None:
            nonlocal loose, held, sequence
            lengths = np.array([len(p[2]) for p in loose], np.int64)
            left, held = [], 0
            for window in best_fit_decreasing(lengths, size):
                used = int(lengths[window].sum())
                if not last and used < size - size // 64:
                    left += [loose[i] for i in window]
                    held += used
                    continue
                at = 0
                for i in window:
                    doc, start, ids, total = loose[i]
                    rows.append((doc, start, ids, total, sequence, at))
                    at += len(ids)
                sequence += 1
            loose = left

        def ready() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([r[0] for r in rows], pa.int64()),
                    "start": pa.array([r[1] for r in rows], pa.int64()),
                    "length": pa.array([len(r[2]) for r in rows], pa.int64()),
                    "ids": pa.array([r[2].astype("<u4").tobytes() for r in rows], pa.binary()),
                    "doc_tokens": pa.array([r[3] for r in rows], pa.int64()),
                    "sequence_id": pa.array([r[4] for r in rows], pa.int64()),
                    "offset": pa.array([r[5] for r in rows], pa.int64()),
                }
            )
            rows.clear()
            return out

        limit = block_windows * size
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = tokenizer.ids(text.as_py() or "")
                ids.append(END_ID)
                tokens = np.array(ids, np.uint16 if max(ids) < 1 << 16 else np.uint32)
                full = len(tokens) // size * size
                for at in range(0, full, size):
                    rows.append((doc, at, tokens[at : at + size], len(tokens), sequence, 0))
                    sequence += 1
                if full < len(tokens):
                    loose.append((doc, full, tokens[full:], len(tokens)))
                    held += len(tokens) - full
                if held >= limit:
                    close(False)
                    limit = held + block_windows * size
                if len(rows) >= 2000:
                    yield ready()
        close(True)
        while rows:
            yield ready()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids instead of the ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.asarray(ids).astype("<u4").tobytes())
