"""Joins in space over tables whose rows share places: whole results, and work that grows with the places, not with pairs of rows."""

import math

import pytest
from pyspark.sql import functions as F

from subsida.operators import joins, spatial


def crowd(spark, places, repeats, key="k"):
    """Rows of `repeats` at each of `places` (x, y), keys counted through."""
    rows = [(i * len(places) + j, float(x), float(y), float(j * j + i)) for i in range(repeats) for j, (x, y) in enumerate(places)]
    return spark.createDataFrame(rows, f"{key} long, x double, y double, v double"), rows


def test_inverse_distance_meets_each_place_once(spark, monkeypatch):
    made, real = {}, joins.materialize
    monkeypatch.setattr(joins, "materialize", lambda df, name: made.setdefault(name, real(df, name)))
    s, src = crowd(spark, [(0, 0), (3, 1), (7, 2)], 20)
    t, dst = crowd(spark, [(1, 1), (3, 1), (9, -4)], 30)
    for power in (2.0, 1.5):
        made.clear()
        got = {r.k: r.v for r in joins.inverse_distance(t.drop("v"), s.drop("k"), "k", "v", power).collect()}
        assert {name: df.count() for name, df in made.items()} == {"sources": 3, "targets": 3}
        assert len(got) == 90
        for k, x, y, _ in dst:
            d = [math.hypot(x - a, y - b) for _, a, b, _ in src]
            want = None if min(d) == 0 else sum(q[3] * e**-power for q, e in zip(src, d)) / sum(e**-power for e in d)
            assert got[k] == (None if want is None else pytest.approx(want))


def brute(left, right, radius):
    return sorted((a[0], b[0], round(math.hypot(a[1] - b[1], a[2] - b[2]), 9)) for a in left for b in right if math.hypot(a[1] - b[1], a[2] - b[2]) < radius)


PLACES = [(0, 0), (0.5, 0.25), (3, 1), (3.5, 1), (-7, 2), (20, 20)]


@pytest.mark.parametrize("unit, share", [(512, 16_000_000), (3, 20)])
def test_pairs_of_crowded_places_are_all_there(spark, monkeypatch, unit, share):
    monkeypatch.setattr(joins, "UNIT", unit)
    monkeypatch.setattr(joins, "SHARE", share)
    a, left = crowd(spark, PLACES, 9)
    b, right = crowd(spark, [(0.25, 0), (3, 1), (-6.5, 2)], 7)
    pairs = joins.within_radius(a, b, 1.0, kept=["k"], of_d={"twice": F.col("d") * 2})
    got = pairs.select("l.k", F.col("r.k").alias("b"), F.round("d", 9).alias("d"), "twice").collect()
    assert sorted((r.k, r.b, r.d) for r in got) == brute(left, right, 1.0)
    assert all(r.twice == pytest.approx(2 * r.d, abs=1e-8) for r in got)
    own = joins.within_radius(a, a, 1.0).select("l.k", F.col("r.k").alias("b"), F.round("d", 9).alias("d"), "l.v").collect()
    assert sorted((r.k, r.b, r.d) for r in own) == brute(left, left, 1.0)
    assert {r.k: r.v for r in own} == {k: v for k, _, _, v in left}
    n = {r.k: (r.n, r.d) for r in joins.summary_within_radius(a, b, 1.0).collect()}
    for k in {p[0] for p in left}:
        d = [p[2] for p in brute([x for x in left if x[0] == k], right, 1.0)]
        assert (k not in n and not d) or n[k] == (len(d), pytest.approx(sum(d) / len(d)))


def test_crowded_cells_are_shared_out(spark, monkeypatch):
    """No key of the join holds much more than SHARE pairs."""
    monkeypatch.setattr(joins, "SHARE", 100)
    points = [(i % 40 / 50, i // 40 / 50) for i in range(1600)]
    p, _ = crowd(spark, points, 1)
    places = joins._places(p, "x", "y", F.lit(1).alias("rows"))
    met = joins._meet(places, places, 1.0)
    assert met.count() > 1_000_000
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "share" in plan and plan.count("RepartitionByExpression") == 2


def test_nearest_joins_places(spark, monkeypatch):
    sizes, real = [], joins.materialize

    def count(df, name):
        made = real(df, name)
        sizes.append((name, made.count()))
        return made

    monkeypatch.setattr(joins, "materialize", count)
    a, left = crowd(spark, PLACES, 9)
    b, right = crowd(spark, [(0.25, 0), (3, 1), (-6.5, 2), (-7.5, 2)], 7, "s")
    got = {r.k: (r.near_s, round(r.d, 9)) for r in joins.nearest_in_space(a, b, 1.0, "k", "s", "left").where("d is not null").collect()}
    assert max(n for name, n in sizes if name == "places") == 6
    best = {}
    for k, s, d in sorted(brute(left, right, 1.0), key=lambda p: (p[2], p[1])):
        best.setdefault(k, (s, d))
    assert got == best


def test_clusters_link_places(spark, monkeypatch):
    edges, real = [], spatial.materialize

    def count(df, name):
        made = real(df, name)
        edges.append(made.count()) if name == "edges" else None
        return made

    monkeypatch.setattr(spatial, "materialize", count)
    a, rows = crowd(spark, PLACES, 9)
    got = {r.k: r.cluster for r in spatial.distance_clusters(a, 1.0, "k").collect()}
    assert got == {k: {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 5}[k % 6] for k, *_ in rows}
    assert edges == [2]
