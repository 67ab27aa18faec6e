"""SimHash near-dedup by a byte-position inverted index with count filtering.

Fingerprints that differ in at most 4 bits differ in at most 4 of their 8 bytes, so a linked pair shares at least
4 positional bytes. Posting lists of single bytes would hold 1/256 of all rows each; the index therefore posts
triples of positional bytes. The 20 triples of a Turan system for (8, 4, 3) suffice: every 4 positions contain
one of them, so every pair with 4 shared bytes meets in a list. In a list the shared positional bytes of a
pair are tallied, pairs below the guaranteed minimum are put aside, the rest are verified on all 64 bits.

Copies collapse to one fingerprint before the index. A list of more than BLOCK fingerprints is cut into blocks
and dealt as pairs of blocks; a long block yields the edges of a spanning forest, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from subsida.llm.common import LOWER_TABLE, materialize, shuffle_partitions
from subsida.llm.components import components

MAX_BITS = 4
SHINGLE = 4
SEED = 42
#: Fingerprints of a posting list that one task compares at once.
BLOCK = 4096
#: Runs up to this length are compared pair by pair, longer ones by a search over what is not reached yet.
SHORT = 16


def index_triples() -> list[tuple[int, int, int]]:
    """Turan's system for 8 points: three parts in a ring; triples within a part, or two of one part and one of the next."""
    part = {p: p % 3 for p in range(8)}
    out = []
    for t in combinations(range(8), 3):
        n = [sum(part[p] == k for p in t) for k in range(3)]
        if 3 in n or any(n[k] == 2 and n[(k + 1) % 3] == 1 for k in range(3)):
            out.append(t)
    return out


TRIPLES = index_triples()


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a UTF-8 text, as a signed integer; 0 for a text without words."""
    words = (text or b"").translate(LOWER_TABLE).split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= shingle:
        hashes = [digest(joined, SEED)]
    else:
        ends, at = [], -1
        for n in map(len, words):
            at += n + 1
            ends.append(at)
        starts = [0, *[e + 1 for e in ends]]
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :])]
    n = len(hashes)
    raw, ones = np.frombuffer(b"".join(hashes), dtype=np.uint8).reshape(n, 8), np.zeros(64, dtype=np.int64)
    for i in range(0, n, 65536):
        ones += np.unpackbits(raw[i : i + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp) of every row; whole texts, streamed through in Arrow batches. text_hash is XXH64 by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(x, shingle) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64())], names=["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _postings(fps: DataFrame) -> DataFrame:
    """(list, fp): every fingerprint under its 20 positional byte triples."""
    byte = lambda p: F.shiftright("fp", 8 * (7 - p)).bitwiseAND(F.lit(255))
    keys = [F.shiftleft(F.lit(i).cast("long"), 24) + F.shiftleft(byte(a), 16) + F.shiftleft(byte(b), 8) + byte(c) for i, (a, b, c) in enumerate(TRIPLES)]
    return fps.select("fp", F.explode(F.array(*keys)).alias("list"))


def _blocked(postings: DataFrame, block: int) -> DataFrame:
    """(list, pair, fp): lists over `block` rows become pairs of hash blocks, each row in every pair of its own."""
    long = postings.groupBy("list").count().where(F.col("count") > block).select("list", F.ceil(F.col("count") / block).cast("int").alias("n"))
    joined = postings.join(materialize(long, "long-lists"), "list", "left")  # most often no list is long
    own = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: F.least(own, j) * F.col("n") + F.greatest(own, j))
    return joined.select("list", "fp", F.explode(F.when(F.col("n").isNull(), F.array(F.lit(0))).otherwise(pairs)).alias("pair"))


def linked(a: np.ndarray, b: np.ndarray, bits: int = MAX_BITS) -> np.ndarray:
    """Count filter, then verification: pairs of fingerprints (uint64) that differ in at most `bits` bits."""
    x = np.bitwise_xor(a, b)
    out = np.zeros(len(x), dtype=bool)
    may = np.flatnonzero((x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= 8 - bits)
    out[may] = np.bitwise_count(x[may]) <= bits
    return out


def _forest(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the link graph, by breadth-first search over the fingerprints not yet reached."""
    rest, edges = fps.copy(), []
    while len(rest):
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            at = todo.pop()
            hit = np.bitwise_count(np.bitwise_xor(rest, at)) <= bits
            if hit.any():
                found = rest[hit]
                edges += [(at, x) for x in found]
                todo += list(found)
                rest = rest[~hit]
    return edges


def _edges_of_runs(runs: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the runs of equal values of `runs` (sorted)."""
    starts = np.flatnonzero(np.r_[True, runs[1:] != runs[:-1]])
    sizes = np.diff(np.r_[starts, len(runs)])
    left, right = [], []
    ids = np.repeat(np.arange(len(starts)), sizes)
    short = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SHORT), sizes))
    f, g = fp[short], ids[short]
    for off in range(1, SHORT):
        if len(f) <= off:
            break
        same = np.flatnonzero(g[off:] == g[:-off])
        if not len(same):
            break
        a, b = f[same], f[same + off]
        ok = linked(a, b, bits)
        left.append(a[ok])
        right.append(b[ok])
    for k in np.flatnonzero(sizes > SHORT):
        e = _forest(fp[starts[k] : starts[k] + sizes[k]], bits)
        if e:
            e = np.array(e, dtype=np.uint64)
            left.append(e[:, 0])
            right.append(e[:, 1])
    none = np.zeros(0, dtype=np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def links(fps: DataFrame, bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints fp that connect every pair at most `bits` bits apart.

    All links of short lists, a spanning forest of long ones: the components are those of the whole link graph.
    """
    if bits > 4:
        raise ValueError("the index guarantees links of up to 4 bits")
    n = shuffle_partitions(fps.sparkSession)
    dealt = _blocked(_postings(fps), block).repartition(n, "list", "pair").sortWithinPartitions("list", "pair", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out(cols):
            key = cols[0] * np.int64(1 << 32) + cols[1] if len(cols[0]) else cols[0]
            a, b = _edges_of_runs(key, cols[2].view(np.uint64), bits)
            a, b = a.view(np.int64), b.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for batch in batches:
            held.append([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
            size += batch.num_rows
            if size < 4 * block:
                continue
            cols = [np.concatenate(c) for c in zip(*held)]
            change = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]))
            cut = change[-1] + 1 if len(change) else 0
            if cut:
                yield out([c[:cut] for c in cols])
            held, size = [[c[cut:] for c in cols]], len(cols[0]) - cut
        if size:
            yield out([np.concatenate(c) for c in zip(*held)])

    return dealt.select("list", "pair", "fp").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """(doc_id, text_hash, fp, component_id) of every row of docs.

    component_id is the smallest doc_id that is reachable over links (null if none of the component has an id).
    Null, empty and blank texts have fingerprint 0 and link like any other; equal texts always link; a repeated row is returned
    as often as it occurs; an empty table gives an empty result.
    """
    fps = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct-fingerprints")
    roots = components(links(distinct.select("fp"), bits, block))
    reps = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    reps = reps.groupBy("root").agg(F.min("rep").alias("component_id")).join(reps.select("root", "fp"), "root")
    return fps.join(reps.select("fp", "component_id"), "fp").select("doc_id", "text_hash", "fp", "component_id")


def op2_simhash(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    out = near_duplicates(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame) -> DataFrame:
    """docs less near copies, by keep_one()."""
    return keep_one(docs, near_duplicates(docs))


def keep_one(docs: DataFrame, members: DataFrame) -> DataFrame:
    """docs less near copies, by members (doc_id, text_hash, component_id): of each component the row of the smallest doc_id stays, once.

    Of several texts under that id the one of the smallest hash stays. Rows without an id stay. What goes is chosen in the
    narrow table of members and taken from docs; of rows that are repeated whole, id and text, the first is kept.
    """
    members = members.where("doc_id is not null")
    least = F.min(F.struct("doc_id", "text_hash")).alias("least")
    groups = members.groupBy("component_id").agg(F.count(F.lit(1)).alias("n"), least).where("n > 1")
    members = members.join(groups.select("component_id", "least"), "component_id")
    stays = (F.struct("doc_id", "text_hash") == F.col("least")).alias("stays")
    odd = members.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), stays).agg(F.count(F.lit(1)).alias("n"))
    odd = materialize(odd.where("not stays or n > 1").select("__id", "__hash", F.col("stays").alias("__again")), "copies")
    rows = docs.select(F.struct("*").alias("__row"), F.col("doc_id").cast("long").alias("__id"), F.xxhash64("text").alias("__hash"))
    # one join, then a window by the same keys: texts move once
    left = rows.join(odd, ["__id", "__hash"], "left").where("__again is null or __again")
    nth = F.row_number().over(Window.partitionBy("__id", "__hash").orderBy("__again"))
    return left.withColumn("__nth", nth).where("__again is null or __nth = 1").select("__row.*")
