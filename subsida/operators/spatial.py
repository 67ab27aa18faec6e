"""Grids, clusters and interpolation of scattered points."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from subsida.operators.joins import near_places
from subsida.operators.storage import materialize


def grid_size(per_km2: float) -> float:
    """Cell size in metres: 125 times a power of two."""
    return 125.0 * 2.0 ** math.floor(math.log2(math.sqrt(1e6 / per_km2) / 125))


def empty_cells(points: DataFrame, size: float, box: tuple[float, float, float, float] | None = None, n="n", e="e") -> DataFrame:
    """(cx, cy, n, e): centres of the grid cells inside the box (default: the points') that hold no point."""
    if box is None:
        b = points.agg(F.min(n).alias("n0"), F.min(e).alias("e0"), F.max(n).alias("n1"), F.max(e).alias("e1"))
    else:
        b = points.sparkSession.createDataFrame([tuple(map(float, box))], "n0 double, e0 double, n1 double, e1 double")
    axis = lambda lo, hi: F.sequence(F.lit(1), F.round(F.ceil(F.col(hi) / size) - F.floor(F.col(lo) / size)).cast("int"))
    cells = b.withColumn("cx", F.explode(axis("e0", "e1"))).withColumn("cy", F.explode(axis("n0", "n1")))
    cells = cells.withColumn("n", (F.floor(F.col("n0") / size) + F.col("cy") - 0.5) * size).withColumn("e", (F.floor(F.col("e0") / size) + F.col("cx") - 0.5) * size)
    inside = cells.where(F.col("n").between(F.col("n0"), F.col("n1")) & F.col("e").between(F.col("e0"), F.col("e1")))
    origin = b.select(F.floor(F.col("n0") / size).alias("__gn"), F.floor(F.col("e0") / size).alias("__ge"))
    held = points.crossJoin(F.broadcast(origin)).select((F.ceil(F.col(e) / size) - F.col("__ge")).cast("int").alias("cx"), (F.ceil(F.col(n) / size) - F.col("__gn")).cast("int").alias("cy")).distinct()
    return inside.select("cx", "cy", "n", "e").join(held, ["cx", "cy"], "left_anti")


def output_grid(spark, box: tuple[float, float, float, float], dx: float) -> DataFrame:
    """(x, y) of a regular grid over a box, its ends on multiples of dx."""
    x0, y0, x1, y1 = (math.floor(box[0] / dx), math.floor(box[1] / dx), math.ceil(box[2] / dx), math.ceil(box[3] / dx))
    return spark.range(x0, x1 + 1).select((F.col("id") * dx).alias("x")).crossJoin(spark.range(y0, y1 + 1).select((F.col("id") * dx).alias("y")))


def connected(edges: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """(key, cluster): the smallest key that is reachable over edges (a, b).

    Large-star and small-star steps on minima, each round written to the shared folder; hubs are aggregated, never gathered.
    """
    e, seen = materialize(edges.select("a", "b").where("a <> b").distinct(), "edges"), None
    for _ in range(60):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low, "u").where("v <> m").select(F.greatest("v", "m").alias("a"), F.least("v", "m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        e = materialize(small.distinct(), "stars")
        now = tuple(e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first())
        if now == seen:
            break
        seen = now
    roots = e.groupBy(F.col("a").alias("__k")).agg(F.min("b").alias("__root"))
    return nodes.select(key).join(roots, F.col(key) == F.col("__k"), "left").select(key, F.coalesce("__root", key).alias("cluster"))


def distance_clusters(points: DataFrame, cutoff: float, key: str, x="x", y="y") -> DataFrame:
    """(key, cluster): single linkage; points closer than the cutoff are of one cluster.

    Points of one place are of one cluster at once, so places are linked, each named by its smallest key.
    """
    pairs, places = near_places(points, cutoff, key, x, y)
    roots = connected(pairs, places, "__r").join(places.select("__r", F.col("__x").alias("__px"), F.col("__y").alias("__py")), "__r")
    named = points.select(key, F.col(x).alias("__kx"), F.col(y).alias("__ky"))
    return named.join(roots, (F.col("__kx") == F.col("__px")) & (F.col("__ky") == F.col("__py")), "left").select(key, F.coalesce("cluster", key).alias("cluster"))


def cluster_table(points: DataFrame, clusters: DataFrame, key: str, coords: list[str]) -> DataFrame:
    """(cluster, n, mean coordinates) of every cluster."""
    return points.join(clusters, key).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in coords])


def benchmark_clusters(points: DataFrame, code: str, key: str) -> DataFrame:
    """(key, cluster): points whose location codes are equal but for the ninth character (which tells duplicates apart)."""
    place = F.concat(F.substring(code, 1, 8), F.expr(f"substring({code}, 10, 5)"))
    return points.select(key, F.dense_rank().over(Window.partitionBy(F.substring(place, 1, 4)).orderBy(place)).alias("__r"), place.alias("place")).select(key, F.min(key).over(Window.partitionBy("place")).alias("cluster"))


def average_linkage(xy: np.ndarray, cutoff: float) -> np.ndarray:
    """Cluster numbers by average linkage, merging while the mean distance is under the cutoff (equal points at 0)."""
    members = [[i] for i in range(len(xy))]
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2))
    while len(members) > 1:
        best = min(((d[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(members) for j, b in enumerate(members) if i < j))
        if not (best[0] < cutoff or best[0] == 0):
            break
        members[best[1]] += members.pop(best[2])
    out = np.zeros(len(xy), dtype=np.int64)
    for k, m in enumerate(members):
        out[m] = k
    return out


def colocation_clusters(points: DataFrame, cutoff: float, key: str, x="x", y="y") -> DataFrame:
    """(key, cluster): average linkage within each single-linkage component (a merge under the cutoff never leaves one)."""
    comp = distance_clusters(points, max(cutoff, 1e-9), key, x, y).withColumnRenamed("cluster", "component")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        own = average_linkage(pdf[[x, y]].to_numpy(), cutoff)
        return pd.DataFrame({key: pdf[key], "cluster": pdf.groupby(own)[key].transform("min")})

    return points.select(key, x, y).join(comp, key).groupBy("component").applyInPandas(run, f"{key} {dict(points.dtypes)[key]}, cluster {dict(points.dtypes)[key]}")


def convex_hull(xy: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise (monotone chain)."""
    p = np.unique(np.asarray(xy, dtype=float), axis=0)

    def chain(points):
        out: list = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out

    return p if len(p) < 3 else np.array(chain(p)[:-1] + chain(p[::-1])[:-1])


def in_hull(hull: np.ndarray, xy: np.ndarray) -> np.ndarray:
    a, b = hull, np.roll(hull, -1, axis=0)
    cross = (b[:, 0] - a[:, 0])[None] * (xy[:, 1:2] - a[None, :, 1]) - (b[:, 1] - a[:, 1])[None] * (xy[:, 0:1] - a[None, :, 0])
    return (cross >= -1e-12).all(axis=1)


def delaunay(xy: np.ndarray) -> np.ndarray:
    """Triangles (rows of point numbers) by incremental insertion (Bowyer and Watson)."""
    xy = np.asarray(xy, dtype=float)
    centre, span = xy.mean(axis=0), max(np.ptp(xy, axis=0).max(), 1e-9) * 1e4
    p = np.vstack([xy, centre + span * np.array([[-1.7, -1.0], [1.7, -1.0], [0.0, 2.0]])])
    n = len(xy)

    def circle(t):
        (ax, ay), (bx, by), (cx, cy) = p[list(t)]
        bx, by, cx, cy = bx - ax, by - ay, cx - ax, cy - ay
        d = 2 * (bx * cy - by * cx)
        ux, uy = (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / d, (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / d
        return ax + ux, ay + uy, ux * ux + uy * uy

    tri = {(n, n + 1, n + 2): circle((n, n + 1, n + 2))}
    for i in range(n):
        bad = [t for t, (cx, cy, r) in tri.items() if (p[i, 0] - cx) ** 2 + (p[i, 1] - cy) ** 2 < r * (1 + 1e-12)]
        edges: dict = {}
        for t in bad:
            for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
                k = tuple(sorted(e))
                edges[k] = None if k in edges else e
            del tri[t]
        for e in filter(None, edges.values()):
            t = (e[0], e[1], i)
            a, b, c = p[list(t)]
            if abs((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])) > 1e-14 * span:
                tri[t] = circle(t)
    return np.array([t for t in tri if max(t) < n], dtype=np.int64).reshape(-1, 3)


def barycentric(xy: np.ndarray, triangles: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Weights (targets by points) of linear interpolation; rows of NaN outside all triangles."""
    out = np.full((len(at), len(xy)), np.nan)
    for t in triangles:
        a, b, c = xy[t]
        m = np.array([b - a, c - a]).T
        w = np.linalg.solve(m, (at - a).T).T
        w = np.column_stack([1 - w.sum(axis=1), w])
        new = (w >= -1e-9).all(axis=1) & np.isnan(out[:, 0])
        out[new] = 0.0
        out[np.ix_(new, t)] = w[new]
    return out


def idw_weights(xy: np.ndarray, at: np.ndarray, power: float) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        w = np.sqrt(((at[:, None] - xy[None]) ** 2).sum(axis=2)) ** -power
        return w / w.sum(axis=1, keepdims=True)


def interpolate_linear(targets: DataFrame, xy: np.ndarray, values: np.ndarray, x="x", y="y", extrapolate: bool = False) -> DataFrame:
    """targets with value: linear in the triangles of a small set of points; outside null, or the nearest point's value."""
    triangles = delaunay(xy)

    @F.pandas_udf("double")
    def value(a: pd.Series, b: pd.Series) -> pd.Series:
        at = np.column_stack([a, b]).astype(float)
        w = barycentric(xy, triangles, at)
        out = np.nan_to_num(w) @ values
        outside = np.isnan(w[:, 0])
        if extrapolate and outside.any():
            out[outside] = values[np.argmin(((at[outside][:, None] - xy[None]) ** 2).sum(axis=2), axis=1)]
            outside[:] = False
        return pd.Series(np.where(outside, np.nan, out)).astype(object).where(~outside, None).astype("Float64")

    return targets.withColumn("value", value(x, y))


def concave_outline(xy: np.ndarray, radius: float) -> np.ndarray:
    """Boundary edges (pairs of point numbers) of the triangles whose circumcircle is under the radius (an alpha shape)."""
    edges: dict = {}
    for t in delaunay(xy):
        a, b, c = xy[t]
        la, lb, lc = np.linalg.norm(b - c), np.linalg.norm(c - a), np.linalg.norm(a - b)
        area = abs((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])) / 2
        if area > 0 and la * lb * lc / (4 * area) < radius:
            for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
                k = tuple(sorted(map(int, e)))
                edges[k] = edges.get(k, 0) + 1
    return np.array([e for e, n in edges.items() if n == 1])
