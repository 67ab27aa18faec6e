"""Series that Python takes many at a time give what each gives alone."""

import os

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from subsida.functions.stats import b_method
from subsida.functions.stochastic import covariance
from subsida.operators import runs, series, testing

MODELS = [["constant"], ["constant", "linear"], ["constant", "linear", "heaviside"], ["constant", "periodic"]]


def alone(y, q, library):
    """The rule for one series, term by term."""
    there, best = ~np.isnan(y), (-1, np.inf)
    if not there.all() and there.sum() < 2 * max(h["q"] for h in library):
        return best
    w = np.linalg.inv(q[np.ix_(there, there)])
    for k, h in enumerate(library if there.all() else library[:2]):
        a, dof = h["design"][there], int(there.sum()) - h["q"]
        e = y[there] - a @ np.linalg.solve(a.T @ w @ a, a.T @ w @ y[there])
        ratio = e @ w @ e / b_method(dof, 1 / (2 * len(y)), 0.5)["kb"]
        best = (k, ratio) if ratio < best[1] else best
    return best


@pytest.mark.parametrize("noise", [["WN(sigma=0.3)"], ["WN(sigma=0.3)", "FOGM(rho=0.05,sigma=0.2)"]])
def test_models_of_many_series_are_those_of_each_alone(noise):
    t, rng = 2000 + np.arange(12) / 4, np.random.default_rng(1)
    q, library = covariance(noise, np.zeros((1, 2)), t), testing.hypotheses(MODELS, t - t[0], 2)
    y = rng.normal(size=(40, 12)).cumsum(axis=1) * 0.3
    y[10:][rng.random((30, 12)) < 0.4] = np.nan
    best, ratio, _ = testing.select_models(y, q, library)
    want = [alone(s, q, library) for s in y]
    assert best.tolist() == [k for k, _ in want] and ratio == pytest.approx([r for _, r in want])
    assert {-1, 0, 1} <= set(best.tolist())
    one = [testing.select_models(s[None], q, library) for s in y]  # the number of series is no matter
    assert [int(b[0]) for b, _, _ in one] == best.tolist()


def test_critical_values_are_found_once(monkeypatch):
    calls = []
    monkeypatch.setattr(testing, "b_method", lambda *a: calls.append(a) or b_method(*a))
    testing.critical_value.cache_clear()
    t = 2000 + np.arange(8) / 4
    library = testing.hypotheses(MODELS[:2], t - t[0])
    for _ in range(3):
        testing.select_models(np.random.default_rng(2).normal(size=(50, 8)), np.eye(8), library)
    assert len(calls) == 2  # one for each number of parameters


def test_groups_are_whole_whatever_the_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(k, i) for k in range(20) for i in range(1 + k * k % 23)] + [(None, i) for i in range(9)]
        df = spark.createDataFrame(rows, "k int, i int")

        def fn(table: pa.Table) -> pa.Table:
            at = runs.starts(table, ["k"])
            sizes = np.diff(np.r_[at, table.num_rows])
            assert all((np.diff(table.column("i").to_numpy()[a : a + n]) == 1).all() for a, n in zip(at, sizes))
            return pa.table({"k": table.column("k").take(pa.array(at)), "n": pa.array(sizes)})

        got = {r.k: r.n for r in runs.map_groups(df, ["k"], ["i"], fn, "k int, n long").collect()}
        want = {r.k: r.n for r in df.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
        assert got == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_series_are_fitted_once_and_as_each_alone(spark, tmp_path):
    """Gaps, imprecise samples, a station without a name, and harmonics; batches cut series anywhere."""
    rng, rows = np.random.default_rng(4), []
    for s in [None, *map(str, range(12))]:
        for c in ("up", "north"):
            t = np.sort(rng.uniform(2010, 2014, 20 + len(rows) % 37))
            y = 3 * (t - 2012) + 2 * np.sin(2 * np.pi * t) + rng.normal(0, 0.1, len(t))
            y[rng.random(len(t)) < 0.1] = np.nan
            rows += [(s, c, float(a), None if np.isnan(b) else float(b), float(e), float(20 + a % 1)) for a, b, e in zip(t, y, rng.uniform(0.5, 1.5, len(t)))]
    ts = spark.createDataFrame(rows, "station string, component string, dyear double, y double, sigma double, t double")
    options = {"model": "linear", "periods": (1.0,), "events": {"3": [2011.5]}, "largest_sigma": 1.4}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        par = series.parameters(ts, **options).collect()
        comp = series.components(ts, **options).collect()
        fits = str(tmp_path)
        counted = series.summary(counting(series.parameters(ts, **options), fits)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pdf = pd.DataFrame(rows, columns=["station", "component", "dyear", "y", "sigma", "t"]).astype({"y": float})
    for (s, c), own in pdf.groupby(["station", "component"], dropna=False):
        s = None if pd.isna(s) else s
        fit = series.fit_series(own["dyear"].to_numpy(), own["y"].to_numpy(), own["sigma"].to_numpy(), model="linear", periods=(1.0,), jumps=[2011.5] if s == "3" else [], largest_sigma=1.4, temperature=own["t"].to_numpy())
        got = sorted((r for r in par if (r.station, r.component) == (s, c)), key=lambda r: r.ordinal)
        assert [r.par for r in got] == fit["names"] and [r.estimate for r in got] == pytest.approx(list(fit["x"])) and got[0].n == fit["kept"].sum()
        parts = sorted((r.dyear, r.trend, r.harmonic, r.jumps, r.residual) for r in comp if (r.station, r.component) == (s, c))
        assert np.allclose(parts, np.column_stack([own["dyear"][fit["kept"]], fit["trend"], fit["harmonic"], fit["jumps"], fit["residual"]]))
    assert len(counted) == 26 and all(list(r.amplitudes) == ["365"] for r in counted)
    assert sum(len(p.read_text()) for p in tmp_path.iterdir()) == len(par)  # the fits are made once for the summary


def counting(df, folder):
    """df, with a mark in a file of folder for every row that is made."""

    def run(batches):
        for b in batches:
            with open(f"{folder}/{os.getpid()}", "a") as f:
                f.write("x" * b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema)
