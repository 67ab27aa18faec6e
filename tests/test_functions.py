"""Calendar, coordinates, codes, distributions, stochastic models and the national grid."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from subsida.functions import geo, rdnap, stats
from subsida.functions import stochastic as sm
from subsida.functions import time as tm


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_dyear_and_back(spark):
    df = spark.sql("select timestamp_ntz'2000-01-01 12:00:00' a, timestamp_ntz'2013-05-13 06:30:00' b")
    r = df.select(tm.dyear(F.col("a")).alias("a"), tm.dyear(F.col("b")).alias("b"), tm.dyear_to_timestamp(tm.dyear(F.col("b"))).cast("string").alias("c"), tm.dyear_to_ymdhms(tm.dyear(F.col("b"))).alias("d")).first()
    assert r.a == 2000.0 and r.b == pytest.approx(2000 + (56425.2708333333 - 51544.5) / 365.25)
    assert r.c.startswith("2013-05-13 06:") and (r.d.year, r.d.month, r.d.day, r.d.hour) == (2013, 5, 13, 6)


def test_two_digit_years_and_bad_months(spark):
    m = lambda y, mo, d: tm.ymd_to_mjd(F.lit(y), F.lit(mo), F.lit(d))
    r = one(spark, a=m(0, 1, 1.5), b=m(2000, 1, 1.5), c=m(99, 12, 31.0), d=m(1999, 13, 1.0), e=m(2013, 2, 30.0))
    assert r.a == r.b == 51544.5 and r.c == 51543 and r.d is None and r.e == 56353


def test_gps_week_of_a_group_is_its_earliest(spark):
    df = spark.createDataFrame([("a", 56000.0), ("a", 56010.0), ("b", 56010.0)], "s string, m double")
    got = {(r.s, r.m): (r.g.week, r.g.second) for r in df.withColumn("g", tm.mjd_to_gps(F.col("m"), ["s"])).collect()}
    assert got["a", 56000.0][0] == got["a", 56010.0][0] == 1679 and got["b", 56010.0][0] == 1680
    assert got["a", 56010.0][1] - got["a", 56000.0][1] == 10 * 86400


def test_location_codes(spark):
    rows = [(20.3700625, 2.7821875, 0, "7FG49QCJ+2V"), (20.3701125, 2.782234375, 1, "7FG49QCJ+2VX"), (20.3701135, 2.78223535156, 3, "7FG49QCJ+2VXGJ"), (47.0000625, 8.0000625, 0, "8FVC2222+22"), (-41.2730625, 174.7859375, 0, "4VCPPQGP+Q9")]
    for lat, lon, refine, code in rows:
        got = one(spark, c=geo.olc(F.lit(lat), F.lit(lon), min(refine, 5))).c
        assert got[:11] == code[:11]
    df = spark.createDataFrame([(i, "9F4649CQ+HC") for i in range(3)] + [(9, "9F4649CQ+HX")], "i int, c string")
    assert {r.i: r.c for r in geo.distinct_codes(df, "c", ["i"]).collect()} == {0: "9F4649CQ+HC", 1: "9F4649CQaHC", 2: "9F4649CQbHC", 9: "9F4649CQ+HX"}


def test_local_projection_round_trip(spark):
    grid = spark.createDataFrame([(51 + i / 10, 4 + j / 10, 0.5) for i in range(11) for j in range(11)], "lat double, lon double, h double")
    q = grid.crossJoin(geo.bbox_centre(grid))
    ref = [F.col(c) for c in ("lat0", "lon0", "h0")]
    v = q.withColumn("v", geo.plh_to_neu(F.col("lat"), F.col("lon"), F.col("h"), *ref))
    b = v.withColumn("b", geo.neu_to_plh(F.col("v.n"), F.col("v.e"), F.col("v.u"), *ref)).withColumn("c", geo.plh_to_neu_cartesian(F.col("lat"), F.col("lon"), F.col("h"), *ref))
    worst = b.agg(F.max(F.abs(F.col("b.lat") - F.col("lat"))), F.max(F.abs(F.col("b.lon") - F.col("lon"))), F.max(F.abs(F.col("c.e") - F.col("v.e")))).first()
    assert worst[0] < 1e-9 and worst[1] < 1e-9 and worst[2] < 200


def test_geocentric_round_trip_and_unknown_ellipsoid(spark):
    x = geo.plh_to_xyz(F.lit(52.1), F.lit(5.3), F.lit(43.0))
    r = one(spark, p=geo.xyz_to_plh(x["x"], x["y"], x["z"])).p
    assert (r.lat, r.lon, r.h) == pytest.approx((52.1, 5.3, 43.0), abs=1e-6)
    with pytest.warns(UserWarning):
        assert geo.ellipsoid("nonsense") == geo.ellipsoid("WGS-84")


@pytest.mark.parametrize("form", ["qvec", "qvecd", "scor", "scord", "scov", "scovd", "scof", "scofd"])
def test_covariance_forms(spark, form):
    q = [4.0, 1.0, -0.5, 1.0, 9.0, 2.0, -0.5, 2.0, 16.0]
    v = F.array(*map(F.lit, q))
    assert one(spark, q=geo.covariance_reformat(geo.covariance_reformat(v, "qmat", form), form, "qmat")).q == pytest.approx(q)
    assert one(spark, q=geo.covariance_reformat(F.array(*map(F.lit, [1.0, 5.0, 0.0, 5.0, 1.0, 0.0, 0.0, 0.0, 1.0])), "qmat", form)).q is None


# Published check points of the transformation: national grid, then ETRS89.
POINTS = [(117380.12, 575040.34, 53.160753042, 4.824761912, 42.8614), (247380.56, 604580.78, 53.419482050, 6.776726674, 42.3586), (155000.0, 463000.0, 52.155172897, 5.387203657, 43.2551), (182260.45, 311480.67, 50.792584916, 5.773795548, 245.9478), (64640.89, 440700.01, 51.947393898, 4.072887101, 47.5968)]


def test_national_grid_without_correction_grids(spark):
    df = spark.createDataFrame(POINTS, "x double, y double, lat double, lon double, h double")
    got = df.withColumn("g", rdnap.etrs_to_rd(F.col("lat"), F.col("lon"), F.col("h"))).withColumn("b", rdnap.rd_to_etrs(F.col("g.x"), F.col("g.y"), rdnap.bessel_height(F.col("lat"), F.col("lon"), F.col("h")))).collect()
    for r in got:
        assert math.hypot(r.g.x - r.x, r.g.y - r.y) < 0.3
        assert (r.b.lat, r.b.lon, r.b.h) == pytest.approx((r.lat, r.lon, r.h), abs=1e-6)


def test_grid_files():
    import struct

    x, y = np.arange(0, 60, 10.0), np.arange(0, 80, 10.0)
    z = (x[:, None] * 0.5 - y[None] * 0.25).astype("<f4")
    raw = b"DSBB" + struct.pack("<hh6d", 6, 8, 0, 50, 0, 70, -100, 100) + z.T.tobytes()
    g = rdnap.read_grid(raw)
    assert np.allclose(rdnap.interpolate_grid(g, [20, 23.3, 31.0], [30, 41.7, 20.0]), [2.5, 1.225, 10.5])
    assert np.isnan(rdnap.interpolate_grid(g, [5.0, 49.0, 100.0], [30.0, 30.0, 0.0])).all()


def test_distributions():
    assert stats.chi2_inv(0.95, 1) == pytest.approx(3.841458820694124) and stats.chi2_cdf(stats.chi2_inv(0.3, 7.0), 7) == pytest.approx(0.3)
    b = stats.b_method(1, 0.001, 0.8)
    assert b["k1"] == pytest.approx(3.2905, abs=1e-3) and b["lam0"] == pytest.approx(17.0746, abs=1e-3) and b["kb"] == pytest.approx(b["k1"] ** 2)
    assert stats.ncx2_cdf(stats.ncx2_inv(0.4, 5, 12.0), 5, 12.0) == pytest.approx(0.4)
    assert stats.noncentrality_approx(b["lam0"], 1, b["k1"] ** 2) == pytest.approx(0.8, abs=0.01)
    assert math.isnan(stats.b_method(0, 0.01, 0.5)["kb"])
    with pytest.raises(ValueError):
        stats.b_method(1, 0.0, 0.5)


T = 2001 + np.arange(10) + np.random.default_rng(1).uniform(0.3, 0.8, 10)
XY = np.random.default_rng(2).uniform(-2, 2, (7, 2))


def test_model_language():
    assert sm.parse("iGGM(alphaR=-1.91,,fs=24,ndays=1/24,x=Inf,f=cellCount)") == ("iGGM", {"alphaR": -1.91, "fs": 24, "ndays": 1 / 24, "x": math.inf, "f": "cellCount"})
    assert sm.parse("covmatrix(format=full,size=[3 4],sigma=__import__('os'))")[1]["sigma"].startswith("__import__")
    with pytest.raises(ValueError):
        sm.covariance(["WN(fs=1)"], XY, T)
    with pytest.warns(UserWarning):
        sm.covariance(["WN(sigma=1,typo=2)"], XY, T)


def test_model_identities():
    white = sm.covariance(["WN(sigma=2)"], XY[:1], T)
    for m in ("FOGM(rho=Inf,sigma=2)", "PL(alpha=0,sigma=2)", "iGGM(alphaR=0,alphaL=0,gamma=0.4,sigma=2)"):
        assert np.allclose(sm.covariance([m], XY[:1], T), white)
    power = sm.covariance(["PL(alpha=-0.8,sigma=1)"], XY[:1], T)
    assert np.allclose(sm.covariance(["iGGM(alphaR=-0.8,alphaL=-0.8,gamma=0,sigma=1)"], XY[:1], T), power)
    assert np.allclose(sm.covariance(["iGGM(alphaR=-0.8,alphaL=0,gamma=1,sigma=1)"], XY[:1], T), power)
    n = 4000
    first = sm.ggm(n, -2.0, 0.0, 0.6)  # an autoregressive process
    assert np.allclose(first, 0.6 ** np.arange(n))


def test_layers_and_formats():
    c, s = sm.covariance(["FOGM(rho=0.1,sigma=1)"], XY, T), sm.covariance(["spatialcov(rho=0.3)"], XY, T)
    assert np.allclose(sm.covariance(["FOGM(rho=0.1,sigma=1)", "spatialcov(rho=0.3)"], XY, T), np.kron(c, s))
    both = sm.covariance(["FOGM(rho=0.1,sigma=1)", "spatialcov(rho=0.3)", "WN(sigma=1)"], XY, T)
    assert np.allclose(both, np.kron(c, s) + np.eye(70))
    for m in ("tudinsar4(s20=1,s2s=2,s2t=3,Rs=4,Rt=5)", "tudpred1(s20=1,s2s=2,s2t=3,Rs=4,Rt=5)", "sure(s2z=2,L=3,q=0.7,tref=1999)", "stdev(sigma=2)"):
        q = sm.covariance([m], XY, T)
        assert q.shape == (70, 70) and np.allclose(q, q.T) and np.linalg.eigvalsh(q).min() > -1e-8
    rd = sm.covariance(["tudinsar4rd(s20=1,s2s=2,s2t=3,Rs=4,Rt=5)"], XY, T, points={"cellCount": np.ones(7), "cellSize": np.full(7, np.nan)}, epochs={"cellCount": np.ones(10), "cellSize": np.full(10, np.nan)})
    assert np.allclose(rd, sm.covariance(["tudinsar4(s20=1,s2s=2,s2t=3,Rs=4,Rt=5)"], XY, T))
    a = np.random.default_rng(3).normal(size=(6, 6))
    a = a @ a.T
    low = a.T[np.triu_indices(6)]
    assert np.allclose(sm.covariance(["covmatrix(format=full)"], XY[:3], T[:2], a.ravel()), a)
    assert np.allclose(sm.covariance(["covmatrix(format=lower)"], XY[:3], T[:2], low), a)
    assert np.allclose(sm.symdiags_unpack(sm.symdiags_pack(a)), a)
    blocks = sm.covariance(["covmatrix(format=blkdiag,nd=2,sreg=0)"], XY[:3], T[:2], np.r_[a[:3, :3].ravel(), a[3:, 3:].ravel()])
    assert np.allclose(blocks[:3, :3], a[:3, :3]) and not blocks[:3, 3:].any()
    with pytest.raises(ValueError):
        sm.covariance(["covmatrix(format=precmatrix2)"], XY[:3], T[:2], a.ravel())


def test_exponential_precision():
    x = np.array([0.0, 0.4, 1.9, 2.0, 5.0])
    main, off = sm.exponential_precision(x)
    assert np.allclose(np.diag(main) + np.diag(off, 1) + np.diag(off, -1), np.linalg.inv(sm.exponential(sm.distances(x), 1.0)))


def test_model_updates():
    given = [["WN(sigma=1)"], ["WN(sigma=2)"]]
    assert sm.update_models(given, "gnss", "net.a", {"gnss": [["PL(alpha=1,sigma=1)"]] * 2}) == [["PL(alpha=1,sigma=1)"]] * 2
    assert sm.update_models(given, "gnss", "net.a", None, {"NET_A": [["X(a=1)"], ["Y(a=1)"]]}) == [["WN(sigma=1)", "X(a=1)"], ["WN(sigma=2)", "Y(a=1)"]]
    assert sm.update_models(given, "lev", "other", {"gnss": []}) == given
