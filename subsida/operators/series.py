"""Decomposition of station series: trend, loading, temperature, harmonics, jumps; common modes; periodograms."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subsida.operators.runs import map_groups, starts


def bspline_basis(t: np.ndarray, breaks: np.ndarray, order: int) -> np.ndarray:
    """B-splines of an order on breaks with repeated ends (Cox and de Boor)."""
    k = np.r_[[breaks[0]] * (order - 1), breaks, [breaks[-1]] * (order - 1)]
    b = np.array([((k[i] <= t) & (t < k[i + 1])) | ((t == breaks[-1]) & (k[i] < k[i + 1]) & (k[i + 1] == breaks[-1])) for i in range(len(k) - 1)], dtype=float).T
    for o in range(2, order + 1):
        n = len(k) - o
        new = np.zeros((len(t), n))
        for i in range(n):
            left, right = k[i + o - 1] - k[i], k[i + o] - k[i + 1]
            if left > 0:
                new[:, i] += (t - k[i]) / left * b[:, i]
            if right > 0:
                new[:, i] += (k[i + o] - t) / right * b[:, i + 1]
        b = new
    return b


def trend_model(model, span: float) -> tuple[str, int, float]:
    """(kind, degree or order, knot spacing) of a trend: a degree, vel, acc, auto, or spline<spacing>_<order>."""
    if isinstance(model, (int, float)):
        return "polynomial", max(1, int(model)), 0.0
    m = model.lower()
    if m == "auto":
        return ("spline", 2, 2.0) if span > 2 else ("polynomial", 1, 0.0)
    if m in ("vel", "velocity", "linear"):
        return "polynomial", 1, 0.0
    if m in ("acc", "acceleration", "quadratic"):
        return "polynomial", 2, 0.0
    if m.startswith("spline"):
        import re

        n = list(map(int, re.findall(r"\d+", m)))
        return "spline", n[1] if len(n) > 1 else 3, float(n[0]) if n else 1.0
    raise ValueError(f"unknown trend model {model}")


def design(year: np.ndarray, model="auto", pressure=None, temperature=None, periods=(), jumps=()) -> tuple[np.ndarray, list[str], float]:
    """Design matrix, parameter labels and t0 (the rounded mean year)."""
    t0 = math.floor(year.mean() + 0.5)
    dt = year - t0
    kind, order, spacing = trend_model(model, year.max() - year.min())
    if kind == "polynomial":
        cols, names = [dt**k for k in range(order + 1)], [f"p({k})" for k in range(order + 1)]
    else:
        parts = max(1, math.floor((dt.max() - dt.min()) / spacing + 0.5))
        cols = list(bspline_basis(dt, np.linspace(dt.min(), dt.max(), parts + 1), order).T)
        names = [f"s({i + 1})" for i in range(len(cols))]
    for series, name in ((pressure, "AtmLd"), (temperature, "TempI")):
        if series is not None:
            cols.append(0.1 * (series - series.mean()))
            names.append(name)
    for p in periods:
        days = math.floor(p * 365 + 0.5)
        cols += [np.sin(2 * np.pi * dt / p), np.cos(2 * np.pi * dt / p)]
        names += [f"s({days:3d})", f"c({days:3d})"]
    for i, j in enumerate(jumps):
        cols.append((year > j).astype(float))
        names.append(f"Jump{i + 1}")
    return np.column_stack(cols), names, t0


GROUPS = {"trend": ("p(", "s"), "atmld": ("AtmLd",), "tempi": ("TempI",), "harmonic": (), "jumps": ("Jump",)}


def analyse(year, y, sigma, model="auto", pressure=None, temperature=None, periods=(), jumps=()) -> dict:
    """Weighted least squares of one component: parameters, covariance, fit, residuals, components, rms, omt, velocity."""
    a, names, t0 = design(year, model, pressure, temperature, periods, jumps)
    m, n = a.shape
    w = a / np.asarray(sigma)[:, None] ** 2
    q = np.linalg.pinv(w.T @ a)
    x = q @ (w.T @ y)
    fit, dof = a @ x, max(m - n, 1)
    r = y - fit
    n_trend = n - (pressure is not None) - (temperature is not None) - 2 * len(periods) - len(jumps)
    at, parts = 0, {}
    for part, size in (("trend", n_trend), ("atmld", pressure is not None), ("tempi", temperature is not None), ("harmonic", 2 * len(periods)), ("jumps", len(jumps))):
        parts[part] = a[:, at : at + size] @ x[at : at + size]
        at += int(size)
    omt = float(r @ (r / np.asarray(sigma) ** 2) / dof)
    if names[0] == "p(0)":
        vel, svel = x[1], math.sqrt(q[1, 1] * omt)
    else:  # the trend's derivative at t0
        step = 1e-6
        b, near = design(year, model)[0], np.array([-step, step])
        kind, order, spacing = trend_model(model, year.max() - year.min())
        dt = year - t0
        k = np.linspace(dt.min(), dt.max(), max(1, math.floor(np.ptp(dt) / spacing + 0.5)) + 1)
        basis = bspline_basis(np.clip(near, dt.min(), dt.max()), k, order)
        vel, mid = float((basis[1] - basis[0]) @ x[: b.shape[1]] / (2 * step)), max(n_trend // 2 - 1, 0)
        svel = math.sqrt(q[mid, mid] * omt)
    return {"names": names, "t0": t0, "x": x, "q": q, "fit": fit, "residual": r, "rms": float(np.sqrt(r @ r / dof)), "omt": omt, "vel": float(vel), "svel": svel, "emp": float(np.diff(r).std(ddof=1) / math.sqrt(2)) if m > 2 else 0.0, **parts}


def breaks_of(events: list[float], first: float, last: float, margin: float = 2 / 365) -> list[float]:
    """Event times as jumps, without those within two days of the ends, each once."""
    return sorted({e for e in events if first + margin < e < last - margin})


def fit_series(year, y, sigma, outlier: float = 0.0, rounds: int = 2, largest_sigma: float | None = None, **model) -> dict:
    """analyse() with imprecise samples left out, and again (at most `rounds` times) without residuals over the limit."""
    keep = np.isfinite(y) & np.isfinite(sigma)
    if largest_sigma is not None:
        keep &= sigma <= largest_sigma
    env = {k: model.pop(k, None) for k in ("pressure", "temperature")}
    for _ in range(rounds + 1):
        out = analyse(year[keep], y[keep], sigma[keep], **{k: None if v is None else v[keep] for k, v in env.items()}, **model)
        bad = np.abs(out["residual"]) > outlier if outlier > 0 else np.zeros(keep.sum(), dtype=bool)
        if not bad.any():
            break
        keep[np.flatnonzero(keep)[bad]] = False
    return out | {"kept": keep}


PARAMETERS = "station string, component string, par string, ordinal int, estimate double, qxx double, t0 double, rms double, omt double, vel double, svel double, emp double, n long"
COMPONENTS = "station string, component string, dyear double, y double, trend double, atmld double, tempi double, harmonic double, jumps double, residual double"


def _run(ts: DataFrame, schema: str, emit, options: dict) -> DataFrame:
    """A task fits the series of its stations and components one after another, many a call; a series fits in memory.

    emit gives the columns of a series by name, arrays of one length or single values; station and component are added.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    extra = [c for c in ("p", "t") if c in ts.columns]

    def run(rows: pa.Table) -> pa.Table:
        at = np.r_[starts(rows, ["station", "component"]), rows.num_rows]
        heads = {k: rows.column(k).take(pa.array(at[:-1])).to_pylist() for k in ("station", "component")}
        values = {k: rows.column(k).to_numpy() for k in ("dyear", "y", "sigma", *extra)}
        out, sizes = {k: [] for k in names[2:]}, []
        for i, (a, b) in enumerate(zip(at[:-1], at[1:])):
            opt, own = dict(options), {k: v[a:b] for k, v in values.items()}
            for name, column in (("pressure", "p"), ("temperature", "t")):
                if column in own and not np.isnan(own[column]).any():
                    opt[name] = own[column]
            events = opt.pop("events", {}).get(heads["station"][i], [])
            opt["jumps"] = breaks_of([*events, *opt.pop("jumps", ())], own["dyear"].min(), own["dyear"].max())
            fit = fit_series(own["dyear"], own["y"], own["sigma"], **opt)
            got = emit({k: v[fit["kept"]] for k, v in own.items()}, fit)
            size = len(next(iter(got.values())))
            sizes.append(size)
            for k in names[2:]:
                out[k].append(got[k] if np.ndim(got[k]) else [got[k]] * size)
        repeated = pa.array(np.repeat(np.arange(len(sizes)), sizes))
        columns = [pa.array(heads[k], pa.string()).take(repeated) for k in ("station", "component")]
        types = dict(c.split() for c in schema.split(", "))
        kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "long": pa.int64()}
        for k in names[2:]:
            flat = [x for part in out[k] for x in part] if types[k] == "string" else np.concatenate(out[k]) if out[k] else []
            columns.append(pa.array(flat, kinds[types[k]], from_pandas=True))
        return pa.table(columns, names)

    own = ts.select("station", "component", *[F.col(c).cast("double").alias(c) for c in ("dyear", "y", "sigma", *extra)])
    return map_groups(own, ["station", "component"], ["dyear"], run, schema)


def parameters(ts: DataFrame, **options) -> DataFrame:
    """(station, component, par, estimate, ...) of series (station, component, dyear, y, sigma[, p, t]); options as in fit_series."""

    def emit(own, fit):
        return {"par": fit["names"], "ordinal": np.arange(len(fit["x"])), "estimate": fit["x"], "qxx": np.diag(fit["q"]), **{k: fit[k] for k in ("t0", "rms", "omt", "vel", "svel", "emp")}, "n": len(own["y"])}

    return _run(ts, PARAMETERS, emit, options)


def components(ts: DataFrame, **options) -> DataFrame:
    """(station, component, dyear, y, trend, atmld, tempi, harmonic, jumps, residual) of series."""
    return _run(ts, COMPONENTS, lambda own, fit: own | {k: fit[k] for k in ("trend", "atmld", "tempi", "harmonic", "jumps", "residual")}, options)


def summary(par: DataFrame) -> DataFrame:
    """(station, component, vel, svel, amplitudes by period, rms, omt, emp) of parameters()."""
    head = ("t0", "vel", "svel", "rms", "omt", "emp", "n")
    period = F.when(F.col("par").rlike(r"^[sc]\(\s*\d+\)$"), F.regexp_extract("par", r"(\d+)", 1))
    first = [F.first(c).alias(c) for c in head]
    amp = par.withColumn("period", period).groupBy("station", "component", "period").agg(F.sqrt(F.sum(F.col("estimate") * F.col("estimate"))).alias("a"), *first)
    pairs = F.collect_list(F.when(F.col("period").isNotNull(), F.struct("period", "a")))  # the fits are made once for all
    out = amp.groupBy("station", "component").agg(*first, pairs.alias("__a"))
    return out.withColumn("amplitudes", F.when(F.size("__a") > 0, F.map_from_entries(F.array_sort("__a")))).drop("__a")


def remove_common_mode(comp: DataFrame) -> DataFrame:
    """components() with residual less the mean residual of all stations at that time and component, and that mean as cm."""
    cm = comp.groupBy("component", "dyear").agg(F.avg("residual").alias("cm"))
    return comp.join(cm, ["component", "dyear"]).withColumn("residual", F.col("residual") - F.col("cm"))


def recombine(comp: DataFrame, keep_harmonics: list[str] = ()) -> DataFrame:
    """comp with obs = trend + residual (+ harmonic for listed stations) and aux = what is left."""
    harmonic = F.when(F.col("station").isin(list(keep_harmonics)), F.col("harmonic")).otherwise(0.0) if keep_harmonics else F.lit(0.0)
    out = comp.withColumn("obs", F.col("trend") + F.col("residual") + harmonic)
    return out.withColumn("aux", F.col("y") - F.col("obs"))


def periodogram(ts: DataFrame, frequencies: list[float], by: list[str], t="dyear", y="y") -> DataFrame:
    """(by, frequency, power): the normalised Lomb-Scargle periodogram (Lomb 1976, Scargle 1982), all in aggregates.

    Each series meets each frequency once in the exploded scan; sums are combined before the shuffle.
    """
    mean = ts.groupBy(*by).agg(F.avg(y).alias("__m"), F.avg(t).alias("__t0"), F.var_samp(y).alias("__v"))
    f = F.explode(F.array(*[F.lit(float(x)) for x in frequencies]))
    d = ts.join(mean, by).select(*by, (F.col(t) - F.col("__t0")).alias("t"), (F.col(y) - F.col("__m")).alias("y"), "__v", f.alias("frequency"))
    w = d.withColumn("a", F.lit(2 * math.pi) * F.col("frequency") * F.col("t"))
    c, s = F.cos("a"), F.sin("a")
    g = w.groupBy(*by, "frequency").agg(F.sum(F.col("y") * c).alias("yc"), F.sum(F.col("y") * s).alias("ys"), F.sum(c * c).alias("cc"), F.sum(c * s).alias("cs"), F.count(F.lit(1)).alias("n"), F.first("__v").alias("v"))
    tau = F.atan2(2 * F.col("cs"), 2 * F.col("cc") - F.col("n")) / 2
    g = g.withColumn("ct", F.cos(tau)).withColumn("st", F.sin(tau))
    yc, ys = F.col("yc") * F.col("ct") + F.col("ys") * F.col("st"), F.col("ys") * F.col("ct") - F.col("yc") * F.col("st")
    cc = F.col("ct") * F.col("ct") * F.col("cc") + 2 * F.col("ct") * F.col("st") * F.col("cs") + F.col("st") * F.col("st") * (F.col("n") - F.col("cc"))
    power = (F.try_divide(yc * yc, cc) + F.try_divide(ys * ys, F.col("n") - cc)) / 2
    return g.select(*by, "frequency", F.try_divide(power, F.col("v")).alias("power"))


def stacked_periodogram(p: DataFrame) -> DataFrame:
    return p.groupBy("frequency").agg(F.avg("power").alias("power"))
