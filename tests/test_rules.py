"""Rules worked out by hand: regimes, centering, orbits, series, letters, and cases that once lost rows."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from subsida.functions import geo
from subsida.operators import aggregates as ag
from subsida.operators import joins, testing, transform


def test_reduce_regimes_by_hand(spark):
    rows = [
        (1, 10.0, 1, 0), (1, 14.0, 1, 0), (1, 20.0, 2, 0), (1, 99.0, None, 0),  # two deep, one total, one unclassified
        (2, 7.0, 2, 5), (2, 3.0, 1, 0),  # a lone reflector is deep and stands alone
        (3, 5.0, 2, 0),  # total without deep: no result
        (4, 5.0, 1, 0), (4, None, 1, 0), (4, 8.0, 2, 0),  # a missing value spoils a mean
    ]
    schema = "k int, v double, regime int, pnt_class int"
    got = {r.k: (r.deep, r.total, r.shallow, r.n_deep, r.n_total) for r in ag.reduce_regimes(spark.createDataFrame(rows, schema), ["k"]).collect()}
    assert got == {1: (12.0, 20.0, 8.0, 2, 1), 2: (7.0, None, None, 1, 0), 4: (None, 8.0, None, 2, 1)}
    plain = spark.createDataFrame([(1, 1.0, None, 0), (1, 3.0, 0, 0)], schema)
    r = ag.reduce_regimes(plain, ["k"]).first()
    assert (r.deep, r.total, r.shallow, r.n_deep, r.n_total) == (2.0, None, None, 2, 0)  # no regimes at all: all are deep
    with pytest.raises(Exception, match="class 5"):
        ag.reduce_regimes(spark.createDataFrame([(1, 1.0, 1, 5), (1, 2.0, 1, 5)], schema), ["k"]).collect()


def centred(v, rounds, eps=None):
    v, p, e = v.copy(), 0, 0
    for n in range(rounds):
        a = np.nanmean(v, axis=1)
        v = v - a[:, None]
        b = np.nanmean(v, axis=0)
        v, p, e = v - b, p + a, e + b
        if eps is not None and (a**2).sum() + (b**2).sum() <= eps:
            return v, p, e, n + 1
    return v, p, e, rounds


@pytest.mark.parametrize("rounds, eps", [(1, None), (3, None), (10, 1e-3)])
def test_two_way_center(spark, rounds, eps):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(6, 5)) * 3
    m[rng.random(m.shape) < 0.25] = np.nan
    m[0, 0] = 1.0
    rows = [(i, k, None if np.isnan(m[i, k]) else float(m[i, k])) for i in range(6) for k in range(5)]
    out = ag.two_way_center(spark.createDataFrame(rows, "pnt int, epoch int, v double"), rounds=rounds, eps=eps)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 3  # whatever the number of rounds
    v, p, e, _ = centred(m, rounds, eps)
    for r in out.collect():
        assert r.row_mean == pytest.approx(p[r.pnt]) and r.col_mean == pytest.approx(e[r.epoch])
        assert r.v is None if np.isnan(v[r.pnt, r.epoch]) else r.v == pytest.approx(v[r.pnt, r.epoch])


def test_head_and_tail_keeps_repeated_rows(spark):
    df = spark.createDataFrame([(1, 5), (1, 5), (2, 3)], "pnt int, n int")
    assert ag.head_and_tail(df, "n", "pnt", 10).count() == 3
    many = spark.createDataFrame([(i, i) for i in range(30)], "pnt int, n int")
    assert sorted(r.n for r in ag.head_and_tail(many, "n", "pnt", 5).collect()) == [0, 1, 27, 28, 29]


@pytest.mark.parametrize("a, ecc, incl, node, perigee, nu, kind", [
    (7e6, 0.3, 0.5, 1.0, 2.0, 3.0, "ei"), (7e6, 0.3, 2.5, 5.0, 6.0, 4.0, "ei"), (8e6, 0.2, 0.0, 0.0, 2.0, 1.0, "ee"), (8e6, 0.0, 0.7, 4.0, 0.0, 2.5, "ci"), (8e6, 0.0, 0.0, 0.0, 0.0, 2.5, "ce"),
])
def test_orbits_and_back(spark, a, ecc, incl, node, perigee, nu, kind):
    v = geo.orbit_to_vector(*map(F.lit, (a, ecc, incl, node, perigee, nu)))
    o = spark.range(1).select(v.alias("v")).select(geo.vector_to_orbit(*[F.col(f"v.{c}") for c in ("x", "y", "z", "vx", "vy", "vz")]).alias("o")).first().o
    assert o.kind == kind and o.a == pytest.approx(a) and o.ecc == pytest.approx(ecc, abs=1e-9)
    for got, want in zip((o.incl, o.node, o.perigee, o.nu), (incl, node, perigee, nu)):
        assert np.cos(got - want) == pytest.approx(1.0, abs=1e-9)


def bends(y, t):
    """The double differences by brute force over all triples of epochs."""
    n = y.shape[1]
    rows, obs, w = [], [], []
    for i, j, k in itertools.combinations(range(n), 3):
        f = np.zeros(n)
        for p, q, r in ((i, j, k), (j, i, k), (k, i, j)):
            f[p] = 1 / ((t[p] - t[q]) * (t[p] - t[r]))
        seen = ~np.isnan(y[:, [i, j, k]]).any(axis=1)
        if seen.any():
            rows.append(f)
            obs.append((np.nan_to_num(y[seen]) @ f).mean())
            w.append(seen.sum())
    s = np.sqrt(np.array(w, dtype=float))
    return np.linalg.lstsq(np.array(rows) * s[:, None], np.array(obs) * s, rcond=None)[0]


def test_double_differences_against_brute_force():
    rng = np.random.default_rng(2)
    t = np.cumsum(rng.uniform(0.5, 1.5, 9))
    y = rng.normal(size=(12, 9)).cumsum(axis=1)
    y[rng.random(y.shape) < 0.2] = np.nan
    got, want = transform.double_differences(y, t), bends(y, t)
    flat = lambda x: x - np.polyval(np.polyfit(t, x, 1), t)  # noqa: E731  (both are free up to a line)
    assert np.allclose(flat(got), flat(want), atol=1e-8)


def test_s_transform_of_more_than_a_thousand_epochs():
    rng = np.random.default_rng(3)
    shared = rng.normal(size=1100).cumsum()
    y = shared + rng.normal(size=(5, 1))
    xref, xoff, out = transform.s_transform(y, np.arange(1100.0), "sd-norm")
    assert np.allclose(out, 0, atol=1e-6) and np.allclose(xref, shared - np.median(shared), atol=1e-6)


def test_letters_and_codes_of_many_repeats(spark):
    df = spark.range(800).select(F.lit("9F4649CQ+HC").alias("code"), "id")
    codes = [r.code for r in geo.distinct_codes(df, "code", ["id"]).collect()]
    assert len(set(codes)) == 800
    got = [r.s for r in spark.createDataFrame([(n,) for n in (0, 1, 26, 27, 52, 53, 702, 703)], "n int").select(geo.letters(F.col("n")).alias("s")).collect()]
    assert got == ["", "a", "z", "aa", "az", "ba", "zz", "aaa"]


def test_points_without_a_model_stay(spark):
    rows = [(1, i, float(i)) for i in range(8)] + [(2, 0, 1.0)]
    got = {r.pnt: r for r in testing.classify_points(spark.createDataFrame(rows, "pnt long, epoch_idx int, v double"), [2000.0 + i for i in range(8)], [["constant", "linear"]], ["WN(sigma=1)"], least=2).collect()}
    assert set(got) == {1, 2} and got[1].models == "constant+linear"


def test_nearest_in_time_with_repeated_ids(spark):
    left = spark.createDataFrame([(1, "a", 0.0), (1, "b", 10.0)], "l int, g string, t double")
    right = spark.createDataFrame([(5, "a", 1.0), (6, "b", 10.5)], "r int, g string, t double")
    for tolerance in (None, 2.0):
        got = sorted((r.g, r.near_r, r.dt) for r in joins.nearest_in_time(left, right, "l", "r", "t", tolerance, ["g"]).collect())
        assert got == [("a", 5, 1.0), ("b", 6, 0.5)]


def test_bins_over_ranges_and_sources_in_blocks(spark, monkeypatch):
    times = spark.createDataFrame([(float(i % 97),) for i in range(300)], "t double")
    bins = joins.voronoi_bins(spark.createDataFrame([(i, float(10 * i)) for i in range(10)], "bin int, t double"))
    for r in joins.assign_bins(times, bins).collect():
        assert r.bin == min(9, int((r.t + 5) // 10))
    monkeypatch.setattr(joins, "STATIONS", 3)
    s = spark.createDataFrame([(float(i), 0.0, float(i * i)) for i in range(1, 11)], "x double, y double, v double")
    got = {r.k: r.v for r in joins.inverse_distance(spark.createDataFrame([(0, 0.0, 0.0), (1, 3.0, 0.0)], "k int, x double, y double"), s, "k", "v").collect()}
    w = [1 / i**2 for i in range(1, 11)]
    assert got[0] == pytest.approx(sum(a * i * i for a, i in zip(w, range(1, 11))) / sum(w)) and got[1] is None
