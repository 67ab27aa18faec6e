"""Velocities of points: closed-form regression by group, and joint estimation with a reference series."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def velocities(obs: DataFrame, t="dyear", v="v", pnt="pnt", least: int = 3) -> DataFrame:
    """(pnt, n, t0, vel, offset, rms, svel): unit weights, every point on its own; offset is the level at t0, the mean time.

    Times are centred by group before they are squared, in one shuffle: regr_* aggregate incrementally.
    """
    g = obs.groupBy(pnt).agg(F.count(F.lit(1)).alias("n"), F.avg(t).alias("t0"), F.regr_slope(v, t).alias("vel"), F.avg(v).alias("offset"), F.regr_syy(v, t).alias("__yy"), F.regr_sxy(v, t).alias("__xy"), F.regr_sxx(v, t).alias("__xx")).where(F.col("n") >= least)
    sse = F.greatest(F.col("__yy") - F.try_divide(F.col("__xy") * F.col("__xy"), F.col("__xx")), F.lit(0.0))
    rms = F.sqrt(F.try_divide(sse, (F.col("n") - 2).cast("double")))
    return g.withColumn("rms", rms).withColumn("svel", F.try_divide(F.col("rms"), F.sqrt("__xx"))).drop("__yy", "__xy", "__xx")


def relative_velocities(y: np.ndarray, t: np.ndarray, q: np.ndarray | None = None, refsystem: str = "min-refseries", reference: np.ndarray | None = None, t0: str | float = "mean", weight: float = 1.0, regularise: float = 1e-3, velocity: float = 0.0) -> dict:
    """y[p, e] = v[p] (t - t0) + offset[p] - ref[e], NaN missing: velocities, offsets, reference series, residuals, omt.

    q is the covariance of the observations present (point fastest). The rank defect of two is lifted by constraints:
    minimum-norm, min-refseries, or min-velocities over the reference points.
    """
    p, e = y.shape
    there = ~np.isnan(y.T.ravel())
    if isinstance(t0, str):
        t0 = t.mean() if t0 == "mean" else float((t * (~np.isnan(y)).sum(axis=0)).sum() / (~np.isnan(y)).sum())
    dt = t - t0
    pi, ei = np.tile(np.arange(p), e)[there], np.repeat(np.arange(e), p)[there]
    m, n = len(pi), 2 * p + e
    a = np.zeros((m, n))
    rows = np.arange(m)
    a[rows, pi], a[rows, p + pi], a[rows, 2 * p + ei] = dt[ei], 1.0, -1.0
    obs = y.T.ravel()[there]
    if q is not None:
        try:
            chol = np.linalg.cholesky(q)
        except np.linalg.LinAlgError:
            chol = np.linalg.cholesky(q + regularise * np.eye(m))
        an, yn = np.linalg.solve(chol, a), np.linalg.solve(chol, obs)
    else:
        an, yn = a, obs
    normal, right = an.T @ an, an.T @ yn
    c1, c2 = np.r_[np.zeros(p), np.ones(p), np.ones(e)], np.r_[np.ones(p), np.zeros(p), dt]
    level = 0.0
    if refsystem == "min-refseries":
        c1, c2 = np.r_[np.zeros(2 * p), np.ones(e)], np.r_[np.zeros(2 * p), dt]
    elif refsystem == "min-velocities":
        mask = np.ones(p, dtype=bool) if reference is None else reference
        c1, c2, level = np.r_[np.zeros(2 * p), np.ones(e)], np.r_[mask / mask.sum(), np.zeros(p + e)], velocity
    elif refsystem != "minimum-norm":
        raise ValueError(f"unknown reference system {refsystem}")
    normal = normal + weight * (np.outer(c1, c1) + np.outer(c2, c2))
    seen = np.diag(normal) > 0
    x = np.zeros(n)
    qx = np.zeros((n, n))
    qx[np.ix_(seen, seen)] = np.linalg.inv(normal[np.ix_(seen, seen)])
    x = qx @ (right + weight * level * c2)
    res = np.full((e, p), np.nan)
    res.ravel()[np.flatnonzero(there)] = obs - a @ x
    en = yn - an @ x
    return {"t0": t0, "vel": x[:p], "offset": x[p : 2 * p], "ref": x[2 * p :], "residuals": res.T, "omt": float(en @ en / max(m - n + 2, 1)), "qx": qx}
