"""Least squares, testing, prediction and interpolation: truth recovery and identities on simulated data."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from subsida.operators import aggregates as ag
from subsida.operators import integrate, predict, series, spatial, testing, transform, velocity
from subsida.operators import windows as wn
from subsida.sources.simulate import simulate


def test_integration_recovers_the_truth(spark):
    obs, true = simulate(spark, "small", range(2003, 2009))
    displ, res = integrate.integrate(obs)
    assert res.agg(F.max(F.abs("e"))).first()[0] < 1e-6
    x = displ.groupBy("pnt", "epoch").pivot("part", ["north", "east", "up"]).agg(F.first("x")).toPandas().merge(true.toPandas(), on=["pnt", "epoch"])
    ref = integrate.base_unknowns([(int(r.pnt), int(r.epoch), r.part) for r in displ.select("pnt", "epoch", "part").collect()])
    assert len(ref) == 3 * (10 + 6 - 1)
    for part in ("north", "east", "up"):  # displacements are relative: equal up to a motion common to all points
        d = (x[f"{part}_x"] - x[f"{part}_y"]).groupby(x["epoch"]).agg(np.ptp)
        assert d.max() < 1e-6


def test_integration_model_test_is_near_one(spark):
    obs, _ = simulate(spark, "small", range(2003, 2015), noise=1.0, missing=0.1, seed=3)
    _, res = integrate.integrate(obs)
    omt = ag.model_tests(res.withColumn("e2", F.col("en") * F.col("en")).withColumn("g", F.lit(1)), ["g"]).first().omt
    assert 0.7 < omt < 1.2


def test_relative_velocities():
    rng = np.random.default_rng(1)
    t, v, off = np.arange(2000, 2010.0), rng.normal(0, 2, 8), rng.normal(0, 5, 8)
    ref = rng.normal(0, 1, 10)
    y = v[:, None] * (t - t.mean()) + off[:, None] - ref
    y[2, 3] = np.nan
    for system in ("minimum-norm", "min-refseries", "min-velocities"):
        got = velocity.relative_velocities(y, t, refsystem=system)
        assert np.nanmax(np.abs(got["residuals"])) < 1e-8
        assert np.allclose(got["vel"] - got["vel"][0], v - v[0])
    assert abs(velocity.relative_velocities(y, t, refsystem="min-velocities", velocity=1.5)["vel"].mean() - 1.5) < 1e-6
    with pytest.raises(ValueError):
        velocity.relative_velocities(y, t, refsystem="none")


@pytest.mark.parametrize("method", ["minimum-norm", "sd-norm", "ssd-norm"])
def test_s_transform_removes_what_epochs_share(method):
    rng = np.random.default_rng(2)
    t = np.arange(12.0)
    shared, off = np.r_[0, rng.normal(0, 3, 11)], rng.normal(0, 10, 30)
    y = shared[None] + off[:, None]
    y[rng.random(y.shape) < 0.1] = np.nan
    xref, xoff, z = transform.s_transform(y, t, method)
    slope = np.polyfit(t, xref - shared, 1)[0] if method == "ssd-norm" else 0.0
    assert np.ptp(xref - shared - slope * t) < 1e-6 and abs(np.nanmean(z, axis=1)).max() < 1e-9
    assert transform.s_transform(y, t, "none")[2] is y
    assert not transform.s_transform(y, t, "offsets-only")[0].any()


def test_s_transform_with_stable_points_and_gaps():
    y = np.tile(np.arange(6.0), (5, 1)) * np.array([0, 0, 1, 1, 1])[:, None] + np.array([0, 2, 0, 0, 0, 0])[None]
    stable = np.array([True, True, False, False, False])
    _, _, z = transform.s_transform(y, np.arange(6.0), "sd-norm", stable)
    assert np.abs(np.diff(z[:2], axis=1)).max() < 1e-9
    assert np.allclose(transform.fill_gaps(np.array([0, np.nan, 4, np.nan, 4.0])), [0, transform.fill_gaps(np.array([0, np.nan, 4, np.nan, 4.0]))[1], 4, 4, 4])


def test_series_decomposition(spark):
    rng = np.random.default_rng(3)
    t = np.sort(rng.uniform(2010, 2016, 700))
    y = 3 * (t - 2013) + 2 * np.sin(2 * np.pi * (t - 2013)) + 5 * (t > 2014.2) + rng.normal(0, 0.1, 700)
    y[100] += 40
    ts = spark.createDataFrame(pd.DataFrame({"station": "s", "component": "up", "dyear": t, "y": y, "sigma": 0.1}))
    par = {r.par: r.estimate for r in series.parameters(ts, model="linear", periods=(1.0,), events={"s": [2014.2, 2010.001]}, outlier=10.0).collect()}
    assert par["p(1)"] == pytest.approx(3, abs=0.05) and par["s(365)"] == pytest.approx(2, abs=0.05) and par["Jump1"] == pytest.approx(5, abs=0.1)
    s = series.summary(series.parameters(ts, model="auto", periods=(1.0,), jumps=[2014.2], outlier=10.0)).first()
    assert s.n == 699 and s.vel == pytest.approx(3, abs=0.3) and s.amplitudes["365"] == pytest.approx(2, abs=0.1)
    comp = series.recombine(series.remove_common_mode(series.components(ts, model="linear", periods=(1.0,), jumps=[2014.2])), ["s"])
    assert comp.agg(F.max(F.abs(F.col("obs") + F.col("aux") - F.col("y")))).first()[0] < 1e-9
    with pytest.raises(ValueError):
        series.trend_model("wavelet", 1.0)


def test_periodogram_finds_the_frequency(spark):
    t = np.sort(np.random.default_rng(4).uniform(0, 10, 300))
    ts = spark.createDataFrame(pd.DataFrame({"station": "s", "dyear": t, "y": np.sin(2 * np.pi * 3 * t)}))
    p = {r.frequency: r.power for r in series.stacked_periodogram(series.periodogram(ts, [1.0, 2.0, 3.0, 4.0], ["station"])).collect()}
    assert max(p, key=p.get) == 3.0 and p[3.0] > 100


def test_robust_filter_finds_steps_and_outliers(spark):
    rng = np.random.default_rng(5)
    y = rng.normal(0, 1.5, 1000)
    for at, size in ((300, 30), (550, -50), (610, 30), (630, -50)):
        y[at:] += size
    for at, size in ((200, 50), (500, 60), (600, -70)):
        y[at] += size
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "i0": np.arange(1000), "v": y}))
    f = wn.robust_moving_median(df, "k", ["i0"], "v", 11)
    assert {r.i0 for r in f.where("outlier").collect()} >= {200, 500, 600}
    s = wn.step_scores(f, "k", 11, 5.0)
    found = {r.i0 for r in s.where("is_sed").collect()}
    assert all(any(abs(x - at) <= 1 for x in found) for at in (300, 550, 610, 630)) and len(found) < 12
    level = wn.step_corrected(s, "k", 11).where("i0 between 20 and 280").agg(F.max(F.abs("ys"))).first()[0]
    assert level < 3


def test_hypotheses_and_model_choice(spark):
    t = np.arange(20) / 2
    lib = testing.hypotheses([["constant"], ["constant", "linear"], ["constant", "linear", "heavyside"], ["constant", "breakpoint", "breakpoint"]], t, 2)
    assert [h["q"] for h in lib[:2]] == [1, 2] and sum(h["q"] == 3 for h in lib) == 16 + 256
    y = np.stack([np.full(20, 3.0), 1 + 2 * t, 1 + 2 * t + 6 * (np.arange(20) >= 8), np.where(np.arange(20) % 2, np.nan, 2 * t)])
    rows = [(p, e, float(v)) for p, s in enumerate(y) for e, v in enumerate(s) if not np.isnan(v)] + [(4, 0, 1.0)]
    got = {r.pnt: r for r in testing.classify_points(spark.createDataFrame(rows, "pnt long, epoch_idx int, v double"), (2000 + t).tolist(), [["constant"], ["constant", "linear"], ["constant", "linear", "heaviside"]], ["WN(sigma=0.2)"], evaluate=[2001.0, 2020.0], least=2).collect()}
    assert set(got) == {0, 1, 2, 3, 4} and got[4].models is None and got[2].models == "constant+linear+heaviside" and got[3].models == "constant+linear"
    assert got[1].vel == pytest.approx(2) and got[2].fitted == pytest.approx([3.0, 47.0])


def test_collocation_and_prediction(spark):
    rng = np.random.default_rng(6)
    xy, t = rng.uniform(0, 20, (60, 2)), rng.uniform(2000, 2010, 60)
    signal = np.sin(xy[:, 0] / 4) * 3
    m = predict.Collocation(xy, t, signal, np.eye(60) * 1e-4, "tudpred1(s20=0,s2s=4,s2t=0.01,Rs=10,Rt=5)")
    targets = spark.createDataFrame(pd.DataFrame({"x": xy[:, 0], "y": xy[:, 1], "t": t}))
    got = predict.predict(targets, m, xy[:5], np.full(5, 2.0), np.eye(5) * 0.01, 2005.0).toPandas()
    assert np.abs(got["signal"] - signal).max() < 0.2 and got["signal_var"].min() >= 0
    far = predict.predict(spark.createDataFrame([(1e4, 1e4, 2007.0)], "x double, y double, t double"), m, xy[:5], np.full(5, 2.0), np.eye(5) * 0.01, 2005.0).first()
    assert far.trend == pytest.approx(4.0) and abs(far.signal) < 1 and far.total == pytest.approx(far.trend + far.signal)
    many = predict.Collocation(xy, t, signal, np.eye(60), "sure(s2z=1,L=5,q=0.7,tref=1999)", max_iter=5)
    assert 1 <= many.passes <= 6


def test_triangles_and_hull():
    xy = np.random.default_rng(7).uniform(0, 10, (50, 2))
    tri, hull = spatial.delaunay(xy), spatial.convex_hull(xy)
    area = lambda p: abs(sum(p[i, 0] * p[(i + 1) % len(p), 1] - p[(i + 1) % len(p), 0] * p[i, 1] for i in range(len(p)))) / 2
    assert sum(area(xy[t]) for t in tri) == pytest.approx(area(hull))
    at = np.random.default_rng(8).uniform(-2, 12, (200, 2))
    inside, w = spatial.in_hull(hull, at), spatial.barycentric(xy, tri, at)
    assert (np.isnan(w[:, 0]) != inside).all()
    assert np.allclose(w[inside] @ (xy @ [2.0, -3.0] + 1), at[inside] @ [2.0, -3.0] + 1)
    assert len(spatial.concave_outline(xy, 1e9)) == len(hull)


def test_clusters(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.9, 0.0), (3, 1.8, 0.0), (4, 9.0, 0.0), (5, 9.0, 0.0)], "k long, x double, y double")
    assert {r.k: r.cluster for r in spatial.distance_clusters(p, 1.0, "k").collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}
    assert {r.k: r.cluster for r in spatial.colocation_clusters(p, 1.0, "k").collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}
    assert {r.k: r.cluster for r in spatial.colocation_clusters(p, 0.0, "k").collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4}
    assert {(r.cluster, r.n) for r in spatial.cluster_table(p, spatial.distance_clusters(p, 1.0, "k"), "k", ["x"]).collect()} == {(1, 3), (4, 2)}


def test_linear_interpolation_of_columns(spark):
    xy = np.array([[0.0, 0], [10, 0], [0, 10], [10, 10]])
    at = spark.createDataFrame([(5.0, 5.0), (2.0, 3.0), (20.0, 5.0)], "x double, y double")
    v = xy @ [1.0, 2.0]
    assert [r.value for r in spatial.interpolate_linear(at, xy, v).collect()] == [pytest.approx(15), pytest.approx(8), None]
    assert spatial.interpolate_linear(at, xy, v, extrapolate=True).collect()[2].value in (pytest.approx(10.0), pytest.approx(30.0))
