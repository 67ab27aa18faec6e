"""Exact top-k search with an impact-ordered, score-at-a-time index.

A posting is a row and its component in one dimension; its impact is the component's size, quantised to half octaves.
The postings of one impact and one dimension are a segment. Segments are processed by descending impact for a group of
queries together: each adds query component times row component to the accumulators of the rows it lists. What a row
may still gain or lose is bounded by its m postings not yet processed: their norm times that of the query's m largest
components. A query stops only when these bounds prove that all other rows are
out of its top k, as soon as the rest cost less to rescore than the postings that are still to come; they are
rescored exactly, in integers, a slice at a time.

Accumulators are scaled to the largest component and held in single precision; the bounds take in their rounding, so
numbers of any size go the same way. Rows and queries are dealt out as pairs of blocks; a pair builds its rows' index
once for all its queries and returns k rows for each query. No block grows with the data, and no pair of rows leaves a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 20
SCALE = 64
ROWS = 4096
QUERIES = 4096
#: Queries that are processed together.
TOGETHER = 256
#: Share of the postings' squared mass after which bounds are first tested.
FIRST = 0.9
#: Components that a slice of rescoring holds.
SLICE = 1 << 20
#: The ends of a score.
LEAST_LONG, LARGEST_LONG = -(1 << 63), (1 << 63) - 1


def _scaled(whole: np.ndarray) -> tuple[np.ndarray, float]:
    """Whole numbers over a power of two, so that no size is above 1; and that power."""
    unit = float(2.0 ** np.ceil(np.log2(max(1.0, float(np.abs(whole).max(initial=1.0))))))
    return (whole / unit).astype(np.float32), unit


class ImpactIndex:
    """Rows by id, and their postings in segments of one quantised impact and one dimension, the largest impact first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], np.asarray(vectors, dtype=float)[order]
        scaled, _ = _scaled(self.vectors)
        size = np.abs(scaled)
        impact = np.where(size > 0, np.floor(2 * np.log2(np.where(size > 0, size, 1.0))), -np.inf)
        squares = scaled.astype(float) ** 2
        self.norms = np.sqrt(squares.sum(axis=1))
        rest, whole = squares.sum(axis=1), float(squares.sum())
        #: (segments by dimension, of what is left of every row: norms, number of postings; share of squared mass done)
        self.levels, self.postings, open_ = [], int((size > 0).sum()), (size > 0).sum(axis=1)
        levels = sorted(set(impact[size > 0].tolist()), reverse=True)
        for level in levels:
            here = impact == level
            segments = []
            for d in np.flatnonzero(here.any(axis=0)):
                rows = np.flatnonzero(here[:, d])
                segments.append((int(d), rows, scaled[rows, d][:, None]))
            rest = np.maximum(rest - np.where(here, squares, 0.0).sum(axis=1), 0.0)
            open_ = open_ - here.sum(axis=1)
            self.levels.append((segments, np.sqrt(rest), open_, 1.0 - float(rest.sum()) / whole))

    def search(self, queries: np.ndarray, owners: np.ndarray, k: int, work: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's position, id, score) of the k best rows of every query, rows of its own id apart; equal scores go by id.

        `work` gets the number of postings times queries that were processed, and of rows that were rescored.
        """
        whole = np.asarray(queries, dtype=float)
        q, _ = _scaled(whole)
        n, dims = self.vectors.shape
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        work = {} if work is None else work
        work |= {"processed": work.get("processed", 0), "rescored": work.get("rescored", 0)}
        active = np.arange(len(q))
        total = np.zeros((n, len(q)), dtype=np.float32)
        size = np.zeros((dims + 1, len(q)))
        size[1:] = -np.sort(-np.abs(q).astype(float), axis=1).T
        norms = (np.sqrt((size**2).cumsum(axis=0)) * (1 + 1e-5)).astype(np.float32)  # of every query's m largest components
        rounding = ((dims + 4) * 2.0**-23 * self.norms + dims * 2.0**-120).astype(np.float32)
        best = None
        for turn, (segments, rest, open_, done) in enumerate(self.levels or [([], np.zeros(n), np.zeros(n, dtype=int), 1.0)]):
            qt = np.ascontiguousarray(q[active].T)
            for d, rows, values in segments:
                total[rows] += values * qt[d]
                work["processed"] += len(rows) * len(active)
            last = turn >= len(self.levels) - 1
            if not len(active) or done < FIRST and not last:
                continue
            if best is None:  # rows that are likely to be among the best: any rows give a valid floor, good ones a high one
                m = min(n, 4 * (k + 1))
                best = np.argpartition(total, n - m, axis=0)[n - m :] if m < n else np.repeat(np.arange(n)[:, None], len(active), axis=1)
            reach = norms[:, active][open_]  # for every row by how many of its postings are open
            reach *= rest[:, None].astype(np.float32)
            reach += rounding[:, None] * norms[-1, active]
            if len(best) > k:  # k + 1 rows reach the floor, one may be the query's own
                low = np.take_along_axis(total, best, axis=0) - np.take_along_axis(reach, best, axis=0)
                floor = np.partition(low, len(best) - k - 1, axis=0)[len(best) - k - 1]
                possible = total + reach >= floor[None, :]
            else:
                possible = np.ones_like(total, dtype=bool)
            ready = np.ones(len(active), dtype=bool) if last else possible.sum(axis=0) * dims <= int(open_.sum())
            for c in np.flatnonzero(ready):
                rows = np.flatnonzero(possible[:, c])
                work["rescored"] += len(rows)
                out.append(self._rescore(int(active[c]), rows, whole[active[c]], owners[active[c]], k))
            active, total, best = active[~ready], total[:, ~ready], best[:, ~ready]
            if last:
                break
        out.sort(key=lambda x: int(x[0][0]) if len(x[0]) else -1)
        return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, int), self.ids[:0], np.zeros(0, int))

    def _rescore(self, at: int, rows: np.ndarray, query: np.ndarray, owner, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = rows[self.ids[rows] != owner]
        dims = max(1, self.vectors.shape[1])
        ids, scores = self.ids[:0], np.zeros(0, dtype=np.int64)
        wide = float(np.abs(query).max(initial=0.0)) * float(np.abs(self.vectors[rows]).max(initial=0.0)) * dims >= 2.0**62 if len(rows) else False
        wide = wide or float(np.abs(query).max(initial=0.0)) >= 2.0**62 or len(rows) > 0 and float(np.abs(self.vectors[rows]).max(initial=0.0)) >= 2.0**62
        numbers = (lambda x: np.array([int(c) for c in x.ravel()], dtype=object).reshape(x.shape)) if wide else (lambda x: x.astype(np.int64))
        own = numbers(query)
        for s in range(0, len(rows), max(1, SLICE // dims)):
            part = rows[s : s + max(1, SLICE // dims)]
            ids, scores = np.concatenate([ids, self.ids[part]]), np.concatenate([scores, (numbers(self.vectors[part]) * own).sum(axis=1)])
            order = np.lexsort((ids, -scores))[:k] if not wide else np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], dtype=int)
            ids, scores = ids[order], scores[order]
        return np.full(len(ids), at), ids, scores


def whole_vectors(rows: DataFrame, id_col="vec_id", vector_col="embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<double>): scale * component, to be rounded down when an index is made.

    Rows without an id and vectors null, empty, or with components that are null or not finite (scaled) are left out.
    """
    x = F.transform(F.col(vector_col), lambda c: c.cast("double") * F.lit(float(scale)))
    fit = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    good = rows.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)).where(fit)
    return good.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("v"))


def search(rows: DataFrame, queries: DataFrame, k: int = K, rows_per_block: int = ROWS, queries_per_block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of every query with the rows, its own id apart.

    rows and queries are (vec_id, v). Vectors of different lengths don't meet. Equal scores go to the smaller id; a row that is repeated
    is a candidate as often as it occurs, a repeated query is answered once. Fewer than k candidates are all returned. Scores are
    whole numbers of any size, written as longs; those beyond a long stand at its end, in the order of their doubles.
    """
    queries = queries.dropDuplicates(["vec_id"])
    n, m = rows.count(), queries.count()
    rb, qb = max(1, -(-n // rows_per_block)), max(1, -(-m // queries_per_block))
    block = lambda c, n, seed: F.pmod(F.xxhash64(F.lit(seed), c), F.lit(n)).cast("int")
    left = rows.select("vec_id", "v", F.size("v").alias("dims"), block(F.col("vec_id"), rb, 1).alias("rb"), F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("qb"))
    right = queries.select("vec_id", "v", F.size("v").alias("dims"), F.explode(F.sequence(F.lit(0), F.lit(rb - 1))).alias("rb"), block(F.col("vec_id"), qb, 2).alias("qb"))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64"), "size": pd.Series(dtype="float64")})]
        if len(a) and len(b):
            index = ImpactIndex(a["vec_id"].to_numpy(), np.floor(np.stack(a["v"].to_numpy())))
            for s in range(0, len(b), TOGETHER):
                part = b.iloc[s : s + TOGETHER]
                owners = part["vec_id"].to_numpy()
                at, ids, scores = index.search(np.floor(np.stack(part["v"].to_numpy())), owners, k)
                size = scores.astype(float)
                scores = np.array([min(max(int(x), LEAST_LONG), LARGEST_LONG) for x in scores], dtype=np.int64) if scores.dtype == object else scores
                out.append(pd.DataFrame({"query_id": owners[at], "vec_id": ids, "score": scores, "size": size}))
        return pd.concat(out)

    keys = ["dims", "rb", "qb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, "query_id long, vec_id long, score long, size double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("size"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_topk(embeddings: DataFrame) -> DataFrame:
    rows = whole_vectors(embeddings)
    return search(rows, rows.where("vec_id % 20 = 0"))


ORACLE = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, r::INTEGER AS rank, vec_id, score FROM ranked WHERE r <= 20
"""
