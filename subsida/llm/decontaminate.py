"""Benchmark decontamination by q-gram lemma filtering.

Texts are normalised to bytes: A-Z in lower case, every run of other ASCII characters than letters and digits one
space, other letters as they are. Every benchmark item is covered by tiles of TILE bytes, STEP bytes apart (a shorter
item is one tile), so a passage of TILE + STEP bytes holds a whole tile. A document is contaminated by an item if one
of its tiles occurs with at most k edits, 3 in 40 bytes. Items under MIN_ITEM bytes occur whole and unchanged, between
word bounds; those under Q bytes, which any text may hold by chance, only as the whole of a document.

A tile within k edits shares at least tile + 1 - q (k + 1) q-grams with the place, all of them on k + 1 neighbouring
diagonals. So the q-grams that a document shares with the benchmark are counted in diagonal bands of 2 (k + 1),
each overlapping the next by half; places that meet the bound are aligned within the band, and nothing else is.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subsida.llm.common import materialize, per_process

Q = 8
TILE = 80
STEP = 20
#: Items under so many bytes are looked for whole and without edits.
MIN_ITEM = 40
#: Bytes of benchmark text that one pass holds; a larger benchmark takes several passes.
PASS_BYTES = 32 << 20
#: Bytes of documents that are looked at together; longer texts go in overlapping pieces.
PIECE = 1 << 20

_MAP = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256)], dtype=np.uint8)


def normalise(raw: np.ndarray) -> np.ndarray:
    """Normalised bytes of a UTF-8 text, without spaces at the ends."""
    x = _MAP[raw]
    blank = x == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    if len(keep):
        keep[0] = not blank[0]
    x = x[keep]
    return x[:-1] if len(x) and x[-1] == 32 else x


def budget(tile: int) -> int:
    """Edits that a tile may have; less for short tiles, so that the lemma's bound stays positive."""
    return max(0, min(3 * tile // 40, (tile + 1) // Q - 1))


def _grams(x: np.ndarray) -> np.ndarray:
    """The Q = 8 bytes from every position, as one integer each."""
    if len(x) < Q:
        return np.zeros(0, dtype=np.uint64)
    a = x.astype(np.uint64)
    two = a[:-1] | (a[1:] << np.uint64(8))
    four = two[:-2] | (two[2:] << np.uint64(16))
    return four[:-4] | (four[4:] << np.uint64(32))


class Benchmark:
    """Tiles and the inverted index of q-grams of some items; items stand in one buffer, wide gaps between them."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.gap = np.zeros(2 * TILE, dtype=np.uint8)
        parts, at, self.ids, self.starts, self.sizes = [self.gap], len(self.gap), [], [], []
        short: dict[str, list] = {}
        self.whole: dict[bytes, list] = {}
        for item, text in items:
            x = normalise(np.frombuffer(text, dtype=np.uint8))
            if 0 < len(x) < Q:
                self.whole.setdefault(x.tobytes(), []).append(item)
            elif 0 < len(x) < MIN_ITEM:
                short.setdefault(f" {x.tobytes().decode('latin-1')} ", []).append(item)
            elif len(x):
                self.ids.append(item)
                self.starts.append(at)
                self.sizes.append(len(x))
                parts += [x, self.gap]
                at += len(x) + len(self.gap)
        self.short = ahocorasick.Automaton() if short else None
        for key, own in short.items():
            self.short.add_word(key, own)
        if short:
            self.short.make_automaton()
        self.text = np.concatenate(parts)
        self.tiles = []  # (item's index, start in the buffer, size)
        for i, (s, n) in enumerate(zip(self.starts, self.sizes)):
            size = min(TILE, n)
            self.tiles += [(i, s + o, size) for o in sorted({*range(0, n - size + 1, STEP), n - size})]
        self.tile_starts = np.array([t[1] for t in self.tiles], dtype=np.int64)
        self.k = max([budget(t[2]) for t in self.tiles], default=0)
        self.least = min([t[2] + 1 - Q * (budget(t[2]) + 1) for t in self.tiles], default=1)
        g = _grams(self.text)
        pos = np.flatnonzero(np.convolve(self.text == 0, np.ones(Q, dtype=np.int64))[Q - 1 : Q - 1 + len(g)] == 0) if len(g) else np.zeros(0, dtype=np.int64)
        order = np.argsort(g[pos], kind="stable")
        self.positions = pos[order]
        self.keys, first, self.counts = np.unique(g[pos][order], return_index=True, return_counts=True)
        self.first = first.astype(np.int64)
        self.bits = max(20, int(len(self.keys) * 16).bit_length())
        self.filter = np.zeros(1 << self.bits, dtype=bool)
        self.filter[self._slot(self.keys)] = True

    def whole_items(self, x: np.ndarray) -> set:
        """The short items that a normalised text holds."""
        found = set(self.whole.get(x.tobytes(), ())) if self.whole and len(x) < Q else set()
        if self.short is not None:
            for _, own in self.short.iter(f" {x.tobytes().decode('latin-1')} "):
                found.update(own)
        return found

    def _slot(self, g: np.ndarray) -> np.ndarray:
        return ((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def hits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (position in x, position in the benchmark) that share a q-gram."""
        at, keys = [], []
        for s in range(0, len(x) - Q + 1, 1 << 16):
            g = _grams(x[s : s + (1 << 16) + Q - 1])
            may = np.flatnonzero(self.filter[self._slot(g)])
            at.append(may + s)
            keys.append(g[may])
        if not at or not len(self.keys):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        at, keys = np.concatenate(at), np.concatenate(keys)
        k = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        ok = self.keys[k] == keys
        at, k = at[ok], k[ok]
        n = self.counts[k]
        ends = np.cumsum(n)
        within = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)
        return np.repeat(at, n), self.positions[np.repeat(self.first[k], n) + within]

    def regions(self, x: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """Places that meet the lemma's bound: first and last position in x, and the shared q-grams' positions in x and the benchmark."""
        i, p = self.hits(x)
        out = []
        width, span, n = 2 * (self.k + 1), TILE + self.k, self.least - 1
        for shift in (0, width // 2):
            if len(i) < self.least:
                break
            band = (i - p + len(self.text) + shift) // width
            order = np.argsort((band << 32) | i)
            b, at, of = band[order], i[order], p[order]
            # the same band, and enough hits within the length of a tile
            good = np.flatnonzero((b[n:] == b[: len(b) - n]) & (at[n:] - at[: len(at) - n] <= span))
            if not len(good):
                continue
            ends = np.flatnonzero((np.diff(good) > 1) | (b[good[1:]] != b[good[:-1]])) + 1
            for first, last in zip(good[np.r_[0, ends]], good[np.r_[ends, len(good)] - 1] + n + 1):
                out.append((int(at[first]), int(at[last - 1]), at[first:last], of[first:last]))
        return out

    def matches(self, x: np.ndarray, clip=None) -> dict[tuple[int, int, int], int]:
        """Edits of every (part of x, item index, tile index) found; clip(position) gives a part's number and bounds."""
        found: dict[tuple[int, int, int], int] = {}
        for lo, hi, at, of in self.regions(x):
            part, begin, end = clip(lo) if clip else (0, 0, len(x))
            for t in range(int(np.searchsorted(self.tile_starts, of.min() - TILE)), int(np.searchsorted(self.tile_starts, of.max(), "right"))):
                item, start, size = self.tiles[t]
                k = budget(size)
                own = (of >= start) & (of <= start + size - Q)
                # repeated q-grams pair up many times; the lemma's bound holds for distinct positions
                if (part, t) in found or np.count_nonzero(own) < size + 1 - Q * (k + 1) or min(len(np.unique(of[own])), len(np.unique(at[own]))) < size + 1 - Q * (k + 1):
                    continue
                edits = self._align(x, start, size, k, at[own] - of[own], begin, end)
                if edits is not None:
                    found[part, t] = edits
        return {(part, self.tiles[t][0], t): e for (part, t), e in found.items()}

    def _align(self, x, start, size, k, diagonals, begin, end) -> int | None:
        """Least edits of the tile against x[begin:end] around the diagonals, None if over k."""
        tile = self.text[start : start + size]
        a, b = max(begin, start + int(diagonals.min()) - k), min(end, start + size + int(diagonals.max()) + k)
        if b - a < size - k:
            return None
        if x[a:b].tobytes().find(tile.tobytes()) >= 0:
            return 0
        return banded(tile, x[a:b], k)


def banded(tile: np.ndarray, place: np.ndarray, k: int) -> int | None:
    """Least edits of the whole tile against any part of the place, None if over k.

    Row by row with free ends in the place: the insertions of a row are a running minimum of value - column.
    """
    col = np.arange(len(place) + 1)
    row = np.zeros(len(place) + 1, dtype=np.int64)
    for c in tile:
        nxt = np.empty_like(row)
        nxt[0] = row[0] + 1
        nxt[1:] = np.minimum(row[1:] + 1, row[:-1] + (place != c))
        row = np.minimum.accumulate(nxt - col) + col
        if row.min() > k:
            return None
    return int(row.min())


def scan_batch(bench: Benchmark, texts: pa.Array) -> list[dict[tuple, int]]:
    """Edits by (item, tile) of every text of a binary array (nulls match nothing); a short item is a tile of its own, -1."""
    out: list[dict] = [{} for _ in range(len(texts))]
    gap, held, size, where = np.zeros(2 * TILE, dtype=np.uint8), [np.zeros(2 * TILE, dtype=np.uint8)], 2 * TILE, []

    def flush():
        nonlocal held, size, where
        if where:
            begins = np.array([w[0] for w in where])

            def clip(position):
                n = int(np.searchsorted(begins, position, "right")) - 1
                return n, where[n][0], where[n][0] + where[n][1]

            for (n, item, t), edits in bench.matches(np.concatenate(held), clip).items():
                own = out[where[n][2]]
                at = bench.ids[item], t
                own[at] = min(edits, own.get(at, edits))
        held, size, where = [gap], len(gap), []

    for doc, value in enumerate(texts):
        raw = value.as_buffer() if value.is_valid else None
        if raw is None or raw.size == 0:
            continue
        x = normalise(np.frombuffer(raw, dtype=np.uint8))
        out[doc] |= dict.fromkeys(((item, -1) for item in bench.whole_items(x)), 0)
        for s in range(0, max(len(x), 1), PIECE):
            part = x[s : s + PIECE + 2 * TILE]
            if len(part) < Q:
                continue
            where.append((size, len(part), doc))
            held += [part, gap]
            size += len(part) + len(gap)
            if size >= PIECE:
                flush()
    flush()
    return out


def _passes(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int | None, bytes]]]:
    """The different items in blocks that one pass holds, read block by block.

    Texts of one id go together, unless they are over PASS_BYTES in all or the id is null.
    """
    b = benchmark.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).cast("binary").alias("text")).where("text is not null")
    total = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // PASS_BYTES) or 1
    if n > 1:
        large = b.groupBy("item").agg(F.sum(F.octet_length("text")).alias("bytes")).where((F.col("bytes") > PASS_BYTES) | F.col("item").isNull())
        large = materialize(large.select(F.col("item").alias("__item")), "large-items")  # of known size
        apart = b.join(large, F.col("item").eqNullSafe(F.col("__item")), "left_semi").withColumn("part", F.xxhash64("item", "text"))
        b = apart.unionByName(b.join(large, F.col("item").eqNullSafe(F.col("__item")), "left_anti").withColumn("part", F.xxhash64("item")))
    for i in range(n):
        rows = b if n == 1 else b.where(F.pmod("part", F.lit(n)) == i)
        yield sorted({(r.item, bytes(r.text)) for r in rows.toLocalIterator()}, key=lambda r: (r[0] is None, r))


def _scan(docs: DataFrame, items: list, run, schema) -> tuple[DataFrame, object]:
    held, tag = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex  # at most PASS_BYTES

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = per_process(("benchmark", tag), lambda: Benchmark(held.value))
        for b in batches:
            yield run(bench, b)

    return docs.mapInArrow(over, schema), held


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text="text") -> DataFrame:
    """(doc_id, item_id, n_tiles, min_edits): a row for each document and benchmark item found in it.

    Null and empty texts hold nothing; null items are left out, items without an id have a null item_id; repeated items, and
    several texts of one id, count as one item (beyond PASS_BYTES of texts of one id, one for each pass). A repeated
    document row is returned as often as it occurs; an empty benchmark finds nothing. A benchmark of several passes is
    held one pass at a time: what a pass finds is written before the next begins.
    """

    def run(bench: Benchmark, b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc, found in enumerate(scan_batch(bench, b.column(1))):
            per: dict[int | None, list[int]] = {}
            for (item, _), edits in found.items():
                per.setdefault(item, []).append(edits)
            rows += [(doc, i, len(e), min(e)) for i, e in sorted(per.items(), key=lambda x: (x[0] is None, x[0]))]
        cols = list(zip(*rows)) if rows else [(), (), (), ()]
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int32())], names=["doc_id", "item_id", "n_tiles", "min_edits"])

    schema = f"doc_id {dict(docs.dtypes)[id_col]}, item_id long, n_tiles long, min_edits int"
    rows, out, last = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")), None, None
    for items in _passes(benchmark, item_col, item_text):
        if last is not None:
            part, held = last
            part = materialize(part, "found")
            held.destroy()
            out = part if out is None else out.unionByName(part)
        last = _scan(rows, items, run, schema)
    return last[0] if out is None else out.unionByName(last[0])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col="text") -> DataFrame:
    """docs less the contaminated ones, with all their columns; nothing is shuffled. Passes follow one another, each written."""

    def run(bench: Benchmark, b: pa.RecordBatch) -> pa.RecordBatch:
        at = b.schema.get_field_index(text_col)
        return b.filter(pa.array([not f for f in scan_batch(bench, b.column(at).cast(pa.binary()))], pa.bool_()))

    held = None
    for items in _passes(benchmark, "item_id", "text"):
        if held is not None:
            docs = materialize(docs, "clean")
            held.destroy()
        docs, held = _scan(docs, items, run, docs.schema)
    return docs


def op9_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return find_contamination(docs.select("doc_id", "text"), benchmark)
