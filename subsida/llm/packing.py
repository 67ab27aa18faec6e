"""Token-ID output: best-fit-decreasing packing with a segment tree over capacities.

Documents become ids of a public byte-level vocabulary, each closed by the end-of-text id. What is longer than a
row is split into whole rows and a rest, losslessly. Pieces are placed in decreasing length, each into the fullest row
that still takes it; the segment tree over remaining capacities finds that row in log(row length) steps.

A task packs what its input partition holds, POOL tokens at a time: nothing is shuffled, memory is bounded, and
a lost task packs the same rows again. Every output row is one row of the packed id matrix, in binary:
little-endian 16-bit ids and position ids, cumulative segment lengths, and where each segment stands in its document.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subsida.llm.common import TOKENIZERS, Kept, per_process

VOCABULARY = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 50256
ROW = 2048
#: Tokens that are packed together.
POOL = 1 << 21
#: Words whose ids a worker keeps, over all its tasks.
KEPT = 400_000

SCHEMA = "pack_id long, n_tokens int, ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<long>, doc_offsets array<long>"


class Encoder:
    """Ids of a text as little-endian 16-bit bytes. The split pattern always cuts before a single space that a
    character other than white space follows, so words are encoded once and kept."""

    def __init__(self, vocabulary: str = VOCABULARY):
        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.plain = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.kept = Kept(lambda word: self.raw(" " + word), KEPT)

    def raw(self, text: str) -> bytes:
        return np.array(self.plain.encode_ordinary(text), dtype="<u2").tobytes()

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        words = text.split(" ")
        if "" in words or any(w[0].isspace() for w in words):
            return self.raw(text)
        return self.raw(words[0]) + b"".join(map(self.kept.__getitem__, words[1:]))


class Capacities:
    """A segment tree over remaining capacities 0..size: each node holds the number of open rows below it."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        i = capacity + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove a row of the least capacity >= need; (row, capacity), or None if there is none."""
        count, i = self.count, need + self.leaves
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):  # up to the next subtree on the right that isn't empty
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if count[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        row = self.rows[capacity].pop()
        while i:
            count[i] -= 1
            i >>= 1
        return row, capacity


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Rows as lists of the pieces' indices; every length must be 1..size. Equal lengths go in their order."""
    tree, rows = Capacities(size), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[i])
        if found is None:
            row, capacity = len(rows), size
            rows.append([])
        else:
            row, capacity = found
        rows[row].append(i)
        if capacity > lengths[i]:
            tree.add(capacity - lengths[i], row)
    return rows


def pack_pieces(pieces: list[tuple[int | None, int, bytes]], size: int, end: int = END) -> Iterator[tuple]:
    """(n_tokens, ids, position_ids, cu_seqlens, doc_ids, doc_offsets) of every packed row; pieces are (doc_id, offset, id bytes)."""
    blank, steps = np.array([end], dtype="<u2").tobytes(), np.arange(size, dtype="<u2").tobytes()
    for row in best_fit_decreasing([len(p[2]) // 2 for p in pieces], size):
        own = [pieces[i] for i in row]
        ends = np.cumsum([0, *(len(p[2]) // 2 for p in own)]).tolist()
        ids = b"".join(p[2] for p in own) + blank * (size - ends[-1])
        positions = b"".join(steps[: len(p[2])] for p in own) + bytes(2 * (size - ends[-1]))
        yield ends[-1], ids, positions, ends, [p[0] for p in own], [p[1] for p in own]


def pack(docs: DataFrame, id_col="doc_id", text_col="text", size: int = ROW, vocabulary: str = VOCABULARY, pool: int = POOL) -> DataFrame:
    """Packed rows of all documents (SCHEMA).

    Row i of the matrix is `ids`; segment j of it is ids[cu_seqlens[j]:cu_seqlens[j+1]], starts at token doc_offsets[j] of
    document doc_ids[j], and its position ids start again from 0. The rest of a row is end-of-text with position 0. Null and empty
    texts are a lone end-of-text id; null ids stay null; repeated rows are packed as often as they occur.
    """
    if size > 1 << 16:
        raise ValueError("position ids have 16 bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = per_process(("encoder", vocabulary), lambda: Encoder(vocabulary)), np.array([END], dtype="<u2").tobytes()
        number = TaskContext.get().partitionId() << 40
        pieces, held, width = [], 0, 2 * size

        def out():
            nonlocal pieces, held, number
            rows = list(pack_pieces(pieces, size))
            pieces, held = [], 0
            for s in range(0, len(rows), 256):
                cols = list(zip(*rows[s : s + 256]))
                kinds = [pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
                ids = pa.array(range(number, number + len(cols[0])), pa.int64())
                number += len(cols[0])
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = encode(text.as_py()) + end
                for s in range(0, len(ids), width):
                    pieces.append((doc, s // 2, ids[s : s + width]))
                held += len(ids) // 2
                if held >= pool:
                    yield from out()
        if pieces:
            yield from out()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def unpack(packed: DataFrame) -> DataFrame:
    """(doc_id, offset, ids array<int>) of every segment: the inverse of pack(), for readers and tests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for ids, ends, docs, offsets in zip(*(b.column(i).to_pylist() for i in range(4))):
                x = np.frombuffer(ids, dtype="<u2").astype(np.int32)
                rows += [(d, o, x[s:e]) for s, e, d, o in zip(ends, ends[1:], docs, offsets)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int32()))], names=["doc_id", "offset", "ids"])

    return packed.select("ids", "cu_seqlens", "doc_ids", "doc_offsets").mapInArrow(run, "doc_id long, offset long, ids array<int>")


def op6_packing(docs: DataFrame) -> DataFrame:
    return pack(docs.select("doc_id", "text"))
