"""Covariance models in a small language, such as iGGM(alphaR=-1.91,alphaL=-0.74,gamma=0.9861,sigma=0.0967).

Models are evaluated in numpy, for the blocks that a task or the driver solves; points run fastest in a space-time vector.
Simple models are columns as well (cov_columns), to be used in joins.
"""

from __future__ import annotations

import ast
import operator
import re
import warnings

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_OPS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Pow: operator.pow, ast.USub: operator.neg, ast.UAdd: operator.pos}


def _number(s: str):
    """The value of plain arithmetic such as 1/365 or -Inf, lists in brackets; any other text stays text."""
    def walk(n):
        if isinstance(n, ast.Constant) and isinstance(n.value, (int, float)):
            return n.value
        if isinstance(n, ast.BinOp):
            return _OPS[type(n.op)](walk(n.left), walk(n.right))
        if isinstance(n, ast.UnaryOp):
            return _OPS[type(n.op)](walk(n.operand))
        if isinstance(n, ast.List):
            return [walk(x) for x in n.elts]
        if isinstance(n, ast.Name) and n.id.lower() in ("inf", "nan"):
            return float(n.id.lower())
        raise ValueError(s)

    try:
        return walk(ast.parse(s.strip().replace("^", "**"), mode="eval").body)
    except (ValueError, SyntaxError, KeyError, ZeroDivisionError):
        return s.strip().strip("'\"")


def parse(model: str) -> tuple[str, dict]:
    """Name and parameters of a model; empty arguments are skipped."""
    m = re.fullmatch(r"\s*(\w+)\s*(?:\((.*)\))?\s*", model, re.S)
    if not m:
        raise ValueError(f"not a model: {model}")
    args = re.split(r",(?![^\[]*\])", m[2] or "")
    return m[1], {k.strip(): _number(v) for k, _, v in (a.partition("=") for a in args if a.strip())}


def check(par: dict, required: set[str], optional: set[str] = frozenset()) -> None:
    if missing := required - par.keys():
        raise ValueError(f"missing parameters {sorted(missing)}")
    if unknown := par.keys() - required - optional:
        warnings.warn(f"unknown parameters {sorted(unknown)}", stacklevel=3)


def distances(a: np.ndarray, b: np.ndarray | None = None) -> np.ndarray:
    a = np.asarray(a, dtype=float).reshape(len(a), -1)
    b = a if b is None else np.asarray(b, dtype=float).reshape(len(b), -1)
    return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))


def exponential(d: np.ndarray, rho: float, q: float = 1.0) -> np.ndarray:
    """exp(-(d rho)^q), 1 at distance 0 (also for an infinite rho)."""
    with np.errstate(invalid="ignore"):
        return np.where(d == 0, 1.0, np.exp(-((d * rho) ** q)))


def hosking(n: int, index: float) -> np.ndarray:
    """Fractional integration weights of a spectral index: products of (k - 1 - index / 2) / k."""
    k = np.arange(1, n)
    return np.cumprod(np.r_[1.0, (k - 1 - index / 2) / k])


def ggm(n: int, right: float, left: float, gamma: float) -> np.ndarray:
    """Impulse response of the integrated generalised Gauss-Markov model, the first n terms of a convolution."""
    size = 1 << (2 * n - 1).bit_length()
    damped = gamma ** np.arange(n) * hosking(n, right - left)
    return np.fft.irfft(np.fft.rfft(hosking(n, left), size) * np.fft.rfft(damped, size), size)[:n]


def temporal(name: str, par: dict, t: np.ndarray, attributes: dict | None = None) -> np.ndarray:
    """Covariance over epochs (decimal years) of WN, FOGM, PL or iGGM, averaged over ndays around each."""
    extra = {"fs", "ndays", "leadup"}
    check(par, {"WN": {"sigma"}, "FOGM": {"rho", "sigma"}, "PL": {"alpha", "sigma"}, "iGGM": {"alphaR", "alphaL", "gamma", "sigma"}}[name], extra)
    fs, ndays = par.get("fs", 1), par.get("ndays", 1)
    if isinstance(ndays, str):
        ndays = (attributes or {})[ndays]
    plain = np.ndim(ndays) == 0 and abs(ndays * fs - 1) < 1e-6
    ndays = np.broadcast_to(np.asarray(ndays, dtype=float), len(t))
    if name == "WN":
        return np.diag(par["sigma"] ** 2 / (fs * np.where(ndays == 0, np.inf, ndays)))
    mjd = 51544.5 + (np.asarray(t, dtype=float) - 2000) * 365.25
    start = np.floor(mjd.min() - ndays.max() / 2 - par.get("leadup", 0))
    n = int((np.ceil(mjd.max() + ndays.max() / 2) - start) * fs) + 1
    centre = np.floor((mjd - start) * fs + 0.5).astype(int)  # halves away from zero
    if name == "FOGM" and plain:
        return par["sigma"] ** 2 * exponential(distances(centre), par["rho"])
    first, last = centre - np.floor((ndays * fs - 1) / 2).astype(int), centre + np.floor(ndays * fs / 2).astype(int)
    if plain:
        first = last = centre
    if name == "FOGM":
        c = exponential(np.arange(n, dtype=float), par["rho"])
        lag = np.abs(np.arange(n)[:, None] - np.arange(n)[None, :]) if n < 4000 else None
        mean = np.zeros((len(t), n))
        for j in range(len(t)):
            mean[j, first[j] : last[j] + 1] = 1 / (last[j] - first[j] + 1)
        if lag is not None:
            return par["sigma"] ** 2 * mean @ c[lag] @ mean.T
        size = 1 << (2 * n).bit_length()
        kernel = np.fft.rfft(np.r_[c, np.zeros(size - 2 * n + 1), c[:0:-1]])
        return par["sigma"] ** 2 * mean @ np.fft.irfft(np.fft.rfft(mean, size) * kernel, size)[:, :n].T
    h = par["sigma"] * (ggm(n, par["alphaR"], par["alphaL"], par["gamma"]) if name == "iGGM" else hosking(n, par["alpha"]))
    total = np.r_[0.0, np.cumsum(h)]
    s = np.zeros((len(t), n))  # how a unit of noise at each sample enters each (averaged) epoch
    k = np.arange(n)
    for j in range(len(t)):
        a, b = first[j], last[j]
        s[j, : b + 1] = (total[b - k[: b + 1] + 1] - total[np.maximum(a - k[: b + 1], 0)]) / (b - a + 1)
    return s @ s.T


def sure_time(t1: np.ndarray, t2: np.ndarray, tref: float, q: float) -> np.ndarray:
    power = lambda x: np.abs(x) ** (2 * q)
    return power(t1 - tref)[:, None] + power(t2 - tref)[None, :] - power(t1[:, None] - t2[None, :])


def covariance(models: list[str], xy: np.ndarray, t: np.ndarray, data=None, points: dict | None = None, epochs: dict | None = None, tref: float | None = None) -> np.ndarray:
    """The sum of a list of layers: purely temporal models give a matrix over epochs; after spatialcov, or with a full
    space-time layer, one over all points and epochs. points and epochs hold attributes; data packed covariances."""
    xy, t = np.asarray(xy, dtype=float).reshape(len(xy), -1), np.asarray(t, dtype=float)
    m, n = len(xy), len(t)
    c, r, stage = None, None, 0
    for text in models:
        name, par = parse(text)
        if name in ("WN", "FOGM", "PL", "iGGM"):
            own = temporal(name, par, t, epochs)
            if stage > 1:
                r = r + np.kron(own, np.eye(m))
            else:
                c, stage = own if c is None else c + own, 1
            continue
        if name == "spatialcov":
            check(par, {"rho"}, {"q"})
            s = exponential(distances(xy), par["rho"], par.get("q", 1))
            if stage == 0 and len(models) == 1:
                return s
            if stage != 1:
                raise ValueError("spatialcov must follow the temporal models, once")
            r, stage = np.kron(c, s), 2
            continue
        r = np.kron(c, np.eye(m)) if stage == 1 else np.zeros((m * n, m * n)) if stage == 0 else r
        stage = 3
        r = r + _full(name, par, xy, t, data, points, epochs, tref)
    return c if stage == 1 else r


def _full(name, par, xy, t, data, points, epochs, tref):
    m, n = len(xy), len(t)
    space = lambda rho, q=1.0: exponential(distances(xy), rho, q)
    if name in ("tudinsar4", "tudpred1"):
        check(par, {"s20", "s2s", "s2t", "Rs", "Rt"})
        s, tt = space(1 / par["Rs"]), exponential(distances(t), 1 / par["Rt"])
        if name == "tudpred1":
            return par["s2s"] * np.kron(np.ones((n, n)), s) + par["s2t"] * np.kron(tt, np.ones((m, m)))
        return par["s20"] * np.eye(m * n) + par["s2s"] * np.kron(np.eye(n), s) + par["s2t"] * np.kron(tt, np.eye(m))
    if name == "tudinsar4rd":
        check(par, {"s20", "s2s", "s2t", "Rs", "Rt"}, {"Ns", "Nt", "Ds", "Dt"})
        mi, hi = (np.asarray(points[par.get(k, d)], dtype=float) for k, d in (("Ns", "cellCount"), ("Ds", "cellSize")))
        np_, tp = (np.asarray(epochs[par.get(k, d)], dtype=float) for k, d in (("Nt", "cellCount"), ("Dt", "cellSize")))
        hi, tp = np.where(np.isnan(hi), np.inf, hi), np.where(np.isnan(tp), np.inf, tp)
        f = (1 / mi)[None, :] / np_[:, None]  # epochs by points, so that ravel() runs over points first
        ds = np.sqrt((par["s2s"] * f * (1 + (mi - 1) * np.exp(-hi / par["Rs"]))[None, :]).ravel())
        dt = np.sqrt((par["s2t"] * f * (1 + (np_ - 1) * np.exp(-tp / par["Rt"]))[:, None]).ravel())
        return np.diag(par["s20"] * f.ravel()) + np.outer(ds, ds) * np.kron(np.eye(n), space(1 / par["Rs"])) + np.outer(dt, dt) * np.kron(exponential(distances(t), 1 / par["Rt"]), np.eye(m))
    if name == "sure":
        check(par, {"s2z", "L", "q"}, {"tref", "tlag"})
        ref = par["tref"] if "tref" in par else tref - par["tlag"]
        return 0.5 * par["s2z"] * np.kron(sure_time(t, t, ref, par["q"]), np.ones((m, m))) * np.kron(np.ones((n, n)), space(1 / par["L"], 2))
    if name == "houtenbos":
        check(par, {"s2t", "pt"})
        return np.kron(2 * par["s2t"] * distances(t) ** (2 * par["pt"]), np.eye(m))
    if name == "stdev":
        check(par, set(), {"sigma", "size", "odata"})
        if "sigma" in par:
            return np.eye(m * n) * par["sigma"] ** 2
        o = int(par.get("odata", 0))
        return np.diag(np.asarray(data, dtype=float).ravel()[o : o + m * n] ** 2)
    if name == "covmatrix":
        return unpack(data, par, m, n)
    if name == "precmatrix":
        raise ValueError("precision matrices are not supported")
    raise ValueError(f"unknown model {name}")


def unpack(data, par: dict, m: int, n: int) -> np.ndarray:
    """A packed covariance matrix: full, index, lower/upper, blkdiag (one block an epoch) or symdiags."""
    x, form, size = np.asarray(data, dtype=float).ravel(), par["format"], int(np.prod(par.get("size", [m, n])))
    o = int(par.get("odata", 0))
    if form == "full":
        return x[o : o + size * size].reshape(size, size)
    if form == "index":
        k, oi = int(par["lidx"]), int(par["oidx"])
        idx, r = x[oi : oi + k].astype(int) - 1, np.zeros((size, size))
        r[np.ix_(idx, idx)] = x[o : o + k * k].reshape(k, k)
        return r
    if form in ("lower", "upper"):
        k = int(np.floor(np.sqrt(2 * len(x))))
        r = np.zeros((k, k))
        r.T[np.triu_indices(k)] = x
        return r + np.tril(r, -1).T
    if form == "blkdiag":
        nd = int(par["nd"])
        k = int(round(np.sqrt(len(x) / nd)))
        r, add = np.zeros((k * nd, k * nd)), max(par.get("sreg", 1e-9**0.5), 0) ** 2
        for e in range(nd):
            r[e * k : (e + 1) * k, e * k : (e + 1) * k] = x[e * k * k : (e + 1) * k * k].reshape(k, k) + add
        return r
    if form == "symdiags":
        p = int(par.get("nd", 0)) or len(x) // size
        return symdiags_unpack(x.reshape(p, -1).T)
    raise ValueError(f"unknown format {form}")


def symdiags_pack(a: np.ndarray, count: int | None = None) -> np.ndarray:
    """Cyclic diagonals 0, 1, .. of a symmetric matrix as columns; enough of them hold all of it."""
    m = len(a)
    count = m // 2 + 1 if count is None else count
    return np.stack([a[np.arange(m), (np.arange(m) + d) % m] for d in range(count)], axis=1)


def symdiags_unpack(b: np.ndarray) -> np.ndarray:
    m, a = len(b), np.zeros((len(b), len(b)))
    for d in range(b.shape[1]):
        i, j = np.arange(m), (np.arange(m) + d) % m
        a[i, j] = a[j, i] = b[:, d]
    return a


def exponential_precision(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Main and first off-diagonal of the inverse of exp(-|xi - xj|), x rising: it is tridiagonal."""
    d = np.diff(np.asarray(x, dtype=float))
    e = np.exp(-2 * d)
    off = -np.exp(-d) / (1 - e)
    main = np.r_[0.0, e / (1 - e)] + np.r_[e / (1 - e), 0.0] + 1.0
    return main, off


def cross(model: str, xy0, t0, xy, t, tref: float | None = None) -> np.ndarray:
    """Covariance of signal at (xy0, t0), all combinations, with signal at the paired observations (xy, t)."""
    name, par = parse(model)
    xy0, xy, t0, t = (np.asarray(a, dtype=float) for a in (xy0, xy, t0, t))
    big, times = np.tile(xy0, (len(t0), 1)), np.repeat(t0, len(xy0))
    if name == "tudpred1":
        return par["s2s"] * exponential(distances(big, xy), 1 / par["Rs"]) + par["s2t"] * exponential(distances(times, t), 1 / par["Rt"])
    if name == "sure":
        ref = par["tref"] if "tref" in par else tref - par["tlag"]
        return 0.5 * par["s2z"] * sure_time(times, t, ref, par["q"]) * exponential(distances(big, xy), 1 / par["L"], 2)
    raise ValueError(f"{name} is no prediction model")


def update_models(models: list[list[str]], technique: str, dataset: str, override: dict | None = None, add: dict | None = None) -> list[list[str]]:
    """Models of a dataset's observation types after overrides and additions by technique, then by dataset prefix."""
    dataset = dataset.replace(".", "_")

    def hits(given):
        out = [given[technique]] if technique in given else []
        return out + [v for k, v in given.items() if (dataset.lower().startswith(k.lower()) or k.lower().startswith(dataset.lower())) and dataset != technique and k != technique]

    for new in hits(override or {}):
        models = [list(m) for m in new]
    for new in hits(add or {}):
        models = [list(m) + list(x) for m, x in zip(models, new)]
    return models


def cov_columns(model: str, d: Column, t1: Column, t2: Column, same: Column | None = None) -> Column:
    """A model's covariance between two observations, for joins: spatialcov, sure, WN, FOGM (by days), houtenbos, tudinsar4.

    same says that both are one observation, which noise of its own (s20) asks for; by default those of one place and time are.
    """
    name, p = parse(model)
    dt = F.abs(t1 - t2)
    if name == "spatialcov":
        return F.exp(-F.pow(d * p["rho"], F.lit(float(p.get("q", 1)))))
    if name == "sure":
        w = lambda x: F.pow(F.abs(x), F.lit(2.0 * p["q"]))
        return F.lit(0.5 * p["s2z"]) * (w(t1 - p["tref"]) + w(t2 - p["tref"]) - w(t1 - t2)) * F.exp(-F.pow(d / p["L"], F.lit(2.0)))
    if name == "WN":
        return F.when(dt == 0, p["sigma"] ** 2 / (p.get("fs", 1) * p.get("ndays", 1))).otherwise(0.0)
    if name == "FOGM":
        return F.lit(p["sigma"] ** 2) * F.exp(-F.round(dt * 365.25) * p["rho"])
    if name == "houtenbos":
        return F.when(d == 0, F.lit(2.0 * p["s2t"]) * F.pow(dt, F.lit(2.0 * p["pt"]))).otherwise(0.0)
    if name == "tudinsar4":
        return F.when((d == 0) & (dt == 0) if same is None else same, p["s20"]).otherwise(0.0) + F.when(dt == 0, F.lit(p["s2s"]) * F.exp(-d / p["Rs"])).otherwise(0.0) + F.when(d == 0, F.lit(p["s2t"]) * F.exp(-dt / p["Rt"])).otherwise(0.0)
    raise ValueError(f"{name} is no model for columns")
