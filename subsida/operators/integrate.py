"""Integration of datasets: displacements of points at epochs from observations of all techniques, in one adjustment.

    v = s_north north + s_east east + s_up up + offset(dataset, type, point) + transform(dataset, type, epoch)

Every dataset and observation type is reduced on its own: offsets and transforms are eliminated (Schur complement) and
only the normal equations of displacements leave the task, as triplets that Spark sums. The sum is solved on the driver,
within a checked size, and each dataset finds its offsets, transforms and residuals again in its own task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subsida.functions.stochastic import covariance

#: Displacement unknowns that the driver solves at once (a dense matrix).
MAX_UNKNOWNS = 12_000
PARTS = ("north", "east", "up")


def _weights(pdf: pd.DataFrame, models: dict) -> np.ndarray:
    """Inverse square root (rows) of the observations' covariance: their sigmas, or a model of their dataset and type."""
    found = models.get((pdf["dataset_id"].iloc[0], pdf["obs_type"].iloc[0]))
    if not found:
        return np.diag(1 / pdf["sigma"].to_numpy(dtype=float))
    pts, eps = pdf.drop_duplicates("pnt").sort_values("pnt"), pdf.drop_duplicates("epoch").sort_values("epoch")
    q = covariance(found, pts[["n", "e"]].to_numpy() / 1000, eps["dyear"].to_numpy())
    if len(q) == len(eps):
        q = np.kron(q, np.eye(len(pts)))
    at = pdf["epoch"].map({k: i for i, k in enumerate(eps["epoch"])}).to_numpy() * len(pts) + pdf["pnt"].map({k: i for i, k in enumerate(pts["pnt"])}).to_numpy()
    q = q[np.ix_(at, at)]
    try:
        return np.linalg.inv(np.linalg.cholesky(q))
    except np.linalg.LinAlgError:
        return np.linalg.inv(np.linalg.cholesky(q + 1e-6 * np.trace(q) / len(q) * np.eye(len(q))))


def _parts(pdf: pd.DataFrame, models: dict):
    """Weighted design of displacements (by unknown), of offsets and transforms, and the weighted observations."""
    w = _weights(pdf, models)
    m = len(pdf)
    pi, pk = pd.factorize(pdf["pnt"], sort=True)
    ei, ek = pd.factorize(pdf["epoch"], sort=True)
    a2 = np.zeros((m, len(pk) + len(ek) - 1))
    a2[np.arange(m), pi] = 1.0
    later = ei > 0  # the first transform is the datum of the others
    a2[np.flatnonzero(later), len(pk) + ei[later] - 1] = 1.0
    unknowns, rows, cols, vals = {}, [], [], []
    for p in PARTS:
        s = pdf[f"s_{p}"].to_numpy(dtype=float)
        for r in np.flatnonzero(s):
            key = (int(pdf["pnt"].iloc[r]), int(pdf["epoch"].iloc[r]), p)
            cols.append(unknowns.setdefault(key, len(unknowns)))
            rows.append(r)
            vals.append(s[r])
    a1 = np.zeros((m, len(unknowns)))
    a1[rows, cols] = vals
    return w @ a1, w @ a2, w @ pdf["v"].to_numpy(dtype=float), list(unknowns), (pi, pk, ei, ek)


def reduced_normals(obs: DataFrame, models: dict | None = None) -> DataFrame:
    """(i, j, value): the summed reduced normal equations; i and j are pnt|epoch|part, j is null for the right-hand side."""
    models = models or {}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a1, a2, y, keys, _ = _parts(pdf.sort_values(["epoch", "pnt"]), models)
        q, r = np.linalg.qr(a2)
        q = q[:, np.abs(np.diag(r)) > 1e-9]
        left = a1 - q @ (q.T @ a1)
        n, b = left.T @ left, left.T @ y
        names = np.array(["|".join(map(str, k)) for k in keys], dtype=object)
        i, j = np.nonzero(np.triu(np.abs(n) > 1e-12))
        return pd.DataFrame({"i": np.r_[names[i], names], "j": np.r_[names[j], np.full(len(names), None)], "value": np.r_[n[i, j], b]})

    parts = obs.groupBy("dataset_id", "obs_type").applyInPandas(run, "i string, j string, value double")
    ordered = parts.select(F.when(F.col("j").isNull(), F.col("i")).otherwise(F.least("i", "j")).alias("i"), F.when(F.col("j").isNotNull(), F.greatest("i", "j")).alias("j"), "value")
    return ordered.groupBy("i", "j").agg(F.sum("value").alias("value"))


def base_unknowns(keys: list[tuple[int, int, str]]) -> set[tuple[int, int, str]]:
    """The computing base, held at zero: every point's first epoch, and all epochs of the point that has most of them."""
    first, epochs = {}, {}
    for p, e, part in keys:
        first[p, part] = min(e, first.get((p, part), e))
        epochs.setdefault((part, p), set()).add(e)
    base = {(p, e, part) for (p, part), e in first.items()}
    for part in {k[2] for k in keys}:
        ref = min((p for q, p in epochs if q == part), key=lambda p: (-len(epochs[part, p]), p))
        base |= {(ref, e, part) for e in epochs[part, ref]}
    return base


def solve(normals: DataFrame, base: set | None = None) -> tuple[list, np.ndarray, np.ndarray]:
    """Unknowns, their values and covariance; the base is zero, what no observation determines is NaN."""
    n = normals.where("j is null").count()
    if n > MAX_UNKNOWNS:
        raise ValueError(f"{n} unknowns: more than the {MAX_UNKNOWNS} that are solved at once; narrow the region or the period")
    t = normals.toPandas()
    right = t[t["j"].isna()].sort_values("i")
    keys = [(int(a), int(b), c) for a, b, c in (k.split("|") for k in right["i"])]
    at = {k: i for i, k in enumerate(right["i"])}
    t = t[t["j"].notna()]
    i, j = t["i"].map(at).to_numpy(), t["j"].map(at).to_numpy()
    m = np.zeros((n, n))
    m[i, j] = m[j, i] = t["value"].to_numpy()
    base = base_unknowns(keys) if base is None else base
    free = np.array([k not in base for k in keys])
    x, q = np.zeros(n), np.zeros((n, n))
    if free.any():
        values, vectors = np.linalg.eigh(m[np.ix_(free, free)])
        good = values > 1e-9 * max(values.max(), 1e-300)
        inv = (vectors[:, good] / values[good]) @ vectors[:, good].T
        q[np.ix_(free, free)] = inv
        x[free] = inv @ right["value"].to_numpy()[free]
        weak = (vectors[:, ~good] ** 2).sum(axis=1) > 1e-6
        x[np.flatnonzero(free)[weak]] = np.nan
    return keys, x, q


def integrate(obs: DataFrame, models: dict | None = None, base: set | None = None) -> tuple[DataFrame, DataFrame]:
    """Displacements (pnt, epoch, part, x, sd) and residuals (dataset_id, obs_type, pnt, epoch, v, e, en, r, offset, transform).

    obs is (dataset_id, obs_type, pnt, epoch, dyear, n, e, v, sigma, s_north, s_east, s_up). r are approximate redundancy
    numbers: 1 - 1/n_epoch - 1/n_point + 1/n within a dataset, less the share that the displacements take of all redundancy.
    """
    spark, models = obs.sparkSession, models or {}
    keys, x, q = solve(reduced_normals(obs, models), base)
    sizes = obs.groupBy("dataset_id", "obs_type").agg(F.count(F.lit(1)).alias("m"), (F.count_distinct("pnt") + F.count_distinct("epoch") - 1).alias("n2")).agg(F.sum("m"), F.sum("n2")).first()
    n1 = int(np.linalg.matrix_rank(q)) if len(q) else 0
    share = max(sizes[0] - n1 - sizes[1], 0) / max(sizes[0] - sizes[1], 1)
    sd = np.sqrt(np.diag(q))
    displ = spark.createDataFrame(pd.DataFrame({"pnt": [k[0] for k in keys], "epoch": [k[1] for k in keys], "part": [k[2] for k in keys], "x": x, "sd": sd}), "pnt long, epoch long, part string, x double, sd double")
    wide = displ.groupBy("pnt", "epoch").pivot("part", list(PARTS)).agg(F.first(F.nanvl("x", F.lit(0.0)))).fillna(0.0, list(PARTS))
    joined = obs.join(wide, ["pnt", "epoch"], "left").fillna(0.0, list(PARTS)).withColumn("__d", sum((F.col(f"s_{p}") * F.col(p) for p in PARTS), F.lit(0.0))).drop(*PARTS)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["epoch", "pnt"]).reset_index(drop=True)
        left = pdf.assign(v=pdf["v"] - pdf["__d"])
        _, a2, y, _, (pi, pk, ei, ek) = _parts(left, models)
        z = np.linalg.lstsq(a2, y, rcond=None)[0]
        en = y - a2 @ z
        offset, transform = z[: len(pk)][pi], np.r_[0.0, z[len(pk) :]][ei]
        n_e, n_p = np.bincount(ei)[ei], np.bincount(pi)[pi]
        r = 1 - 1 / n_e - 1 / n_p + 1 / len(pdf)
        r = r * share
        return pdf[["dataset_id", "obs_type", "pnt", "epoch", "v"]].assign(e=left["v"] - offset - transform, en=en, r=r, offset=offset, transform=transform)

    res = joined.groupBy("dataset_id", "obs_type").applyInPandas(run, "dataset_id string, obs_type string, pnt long, epoch long, v double, e double, en double, r double, offset double, transform double")
    return displ, res


def covariance_table(keys: list, q: np.ndarray, part: str | None = None) -> list[tuple]:
    """(pnt, epoch, part, pnt2, epoch2, part2, value) of the upper triangle, all parts or the block of one."""
    at = [i for i, k in enumerate(keys) if part is None or k[2] == part]
    return [(*keys[i], *keys[j], float(q[i, j])) for a, i in enumerate(at) for j in at[a:] if q[i, j]]
