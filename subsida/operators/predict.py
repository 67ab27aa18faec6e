"""Space-time prediction: trend by interpolated velocities, signal by collocation, both with error variances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from subsida.functions import stochastic as st
from subsida.operators.spatial import barycentric, delaunay, idw_weights

#: Residual observations whose covariance is inverted on the driver.
MAX_OBSERVATIONS = 8_000


class Collocation:
    """Weights of residuals under a signal model and a noise covariance; the inverse is made once."""

    def __init__(self, xy, t, residual, noise, model: str, tref: float | None = None, max_iter: int = 0, threshold: float = 1e-3):
        if len(residual) > MAX_OBSERVATIONS:
            raise ValueError(f"{len(residual)} observations: more than the {MAX_OBSERVATIONS} that are inverted at once; thin or tile them")
        self.xy, self.t, self.model, self.tref = np.asarray(xy, dtype=float), np.asarray(t, dtype=float), model, tref
        signal = self.among(self.xy, self.t)
        self.inverse = np.linalg.inv(signal + np.asarray(noise, dtype=float))
        # repeated passes predict what the passes before have left of the residuals
        left, self.alpha, self.passes = np.asarray(residual, dtype=float), np.zeros(len(residual)), 0
        change = np.inf
        while change > threshold and self.passes <= max_iter:
            step = self.inverse @ left
            self.alpha += step
            predicted = signal @ step
            change = np.abs(predicted).sum()
            left = left - predicted
            self.passes += 1

    def among(self, xy, t) -> np.ndarray:
        """Signal covariance of paired places and times."""
        name, par = st.parse(self.model)
        if name == "tudpred1":
            return par["s2s"] * st.exponential(st.distances(xy), 1 / par["Rs"]) + par["s2t"] * st.exponential(st.distances(t), 1 / par["Rt"])
        if name == "sure":
            ref = par["tref"] if "tref" in par else self.tref - par["tlag"]
            return 0.5 * par["s2z"] * st.sure_time(t, t, ref, par["q"]) * st.exponential(st.distances(xy), 1 / par["L"], 2)
        raise ValueError(f"{name} is no prediction model")

    def cross(self, xy0, t0) -> np.ndarray:
        """Signal covariance of paired targets with the observations."""
        name, par = st.parse(self.model)
        if name == "tudpred1":
            return par["s2s"] * st.exponential(st.distances(xy0, self.xy), 1 / par["Rs"]) + par["s2t"] * st.exponential(st.distances(t0, self.t), 1 / par["Rt"])
        ref = par["tref"] if "tref" in par else self.tref - par["tlag"]
        return 0.5 * par["s2z"] * st.sure_time(np.asarray(t0), self.t, ref, par["q"]) * st.exponential(st.distances(xy0, self.xy), 1 / par["L"], 2)

    def variance(self, t0) -> np.ndarray:
        name, par = st.parse(self.model)
        if name == "tudpred1":
            return np.full(len(t0), par["s2s"] + par["s2t"])
        ref = par["tref"] if "tref" in par else self.tref - par["tlag"]
        return par["s2z"] * np.abs(np.asarray(t0) - ref) ** (2 * par["q"])


def predict(targets: DataFrame, model: Collocation, velocity_xy: np.ndarray, velocity: np.ndarray, velocity_cov: np.ndarray, t0: float, design: np.ndarray | None = None, method: str = "idw", power: float = 2.0) -> DataFrame:
    """targets (x, y, t, ...) with trend, signal, total and their error variances.

    Targets of any number stream through in batches; the observations' inverse is what every task holds. design is the velocity
    part of the trend's design (observations by velocity points): it carries the trend's error through the signal.
    """
    held = targets.sparkSession.sparkContext.broadcast((model, velocity_xy, velocity, velocity_cov, design, delaunay(velocity_xy) if method == "linear" else None))  # at most MAX_OBSERVATIONS squared

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, vxy, v, qv, a, triangles = held.value
        for pdf in batches:
            xy, t = pdf[["x", "y"]].to_numpy(dtype=float), pdf["t"].to_numpy(dtype=float)
            k = m.cross(xy, t)
            gain = k @ m.inverse
            w = barycentric(vxy, triangles, xy) if method == "linear" else idw_weights(vxy, xy, power)
            trend = (t - t0) * (w @ v)
            r = (t - t0)[:, None] * w - (gain @ a if a is not None else 0.0)
            out = {"trend": trend, "signal": k @ m.alpha, "trend_var": np.einsum("ij,jk,ik->i", r, qv, r), "signal_var": np.maximum(m.variance(t) - np.einsum("ij,ij->i", gain, k), 0.0)}
            yield pdf.assign(**out, total=out["trend"] + out["signal"], total_var=out["trend_var"] + out["signal_var"])

    extra = "trend double, signal double, trend_var double, signal_var double, total double, total_var double"
    return targets.mapInPandas(run, f"{', '.join(f'{c} {t}' for c, t in targets.dtypes)}, {extra}")
