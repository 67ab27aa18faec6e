"""Clusters, covariances, spectra and least squares over the driver's tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from subsida.functions import stochastic
from subsida.operators import difference, integrate, joins, predict, series, spatial, testing, transform, velocity
from subsida.plans.bindings import SQL_CAMPAIGN, SQL_EVENTS, SQL_REGIONS, SQL_SUPPLIERS, campaign, event_series, read, regions, rounded, rounded_long, suppliers
from subsida.plans.queries_functions import _NEU, local_suppliers
from subsida.plans.registry import query
from subsida.sources.simulate import simulate

_E = f"e AS ({SQL_EVENTS})"
_XY = f"xy AS (SELECT k, lat * 110.0 AS x, lon * 66.0 AS y FROM ({SQL_SUPPLIERS}) p)"


def _xy(spark, d):
    return suppliers(spark, d).select("k", (F.col("lat") * 110.0).alias("x"), (F.col("lon") * 66.0).alias("y"))


@query("cluster_components", f"""WITH RECURSIVE {_XY}, l AS (SELECT a.k AS a, b.k AS b FROM xy a, xy b WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) < 3.3001), r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT a AS k, min(b) AS cluster FROM r GROUP BY a""")
def cluster_components(spark, d):
    return spatial.distance_clusters(_xy(spark, d), 3.3001, "k")


@query("empty_cells", f"""WITH {_NEU}, b AS (SELECT min(n) AS n0, min(e) AS e0, max(n) AS n1, max(e) AS e1, 4000.0::DOUBLE AS s FROM neu), g AS (SELECT *, unnest(range(1, (ceil(e1 / s) - floor(e0 / s))::BIGINT + 1)) AS cx FROM b),
h AS (SELECT *, unnest(range(1, (ceil(n1 / s) - floor(n0 / s))::BIGINT + 1)) AS cy FROM g), z AS (SELECT cx, cy, (floor(n0 / s) + cy - 0.5) * s AS n, (floor(e0 / s) + cx - 0.5) * s AS e, n0, n1, e0, e1 FROM h)
SELECT cx::INTEGER AS cx, cy::INTEGER AS cy, n, e FROM z WHERE n BETWEEN n0 AND n1 AND e BETWEEN e0 AND e1 AND (cx, cy) NOT IN (SELECT (ceil(e / s) - floor(e0 / s))::BIGINT, (ceil(n / s) - floor(n0 / s))::BIGINT FROM (SELECT neu.n, neu.e, n0, e0, s FROM neu, b))""")
def empty_cells(spark, d):
    return spatial.empty_cells(local_suppliers(spark, d).select("k", "n", "e"), 4000.0)


@query("output_grid", "SELECT a::DOUBLE * 2.5 AS x, b::DOUBLE * 2.5 AS y FROM range(-4, 9) t(a), range(0, 5) u(b)")
def output_grid(spark, d):
    return spatial.output_grid(spark, (-9.9, 0.1, 19.0, 9.0), 2.5)


@query("benchmark_clusters", f"""WITH p AS ({SQL_SUPPLIERS}), c AS (SELECT k, floor((lat + 90) * 20)::BIGINT AS y, floor((lon + 180) * 20)::BIGINT AS x FROM p) SELECT k, min(k) OVER (PARTITION BY y, x) AS cluster FROM c""")
def benchmark_clusters(spark, d):
    from subsida.functions import geo

    coded = suppliers(spark, d).select("k", F.rpad(F.substring(geo.olc(F.col("lat"), F.col("lon")), 1, 6), 14, "0").alias("code"))
    return spatial.benchmark_clusters(coded, "code", "k").select("k", "cluster")


#: Distance beyond which a covariance counts as none.
REACH = 8.0001


def _pairs(spark, d, **of_d):
    """Ordered pairs (a, b, d, of_d) within the covariance's reach."""
    p = _xy(spark, d)
    return joins.within_radius(p, p, REACH, kept=["k"], of_d=of_d).select(F.col("l.k").alias("a"), F.col("r.k").alias("b"), "d", *of_d)


@query("cov_exp", f"WITH {_XY} SELECT a.k AS a, b.k AS b, round(exp(-pow(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) * 0.05, 1.5)), 9) AS c FROM xy a, xy b WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) < 8.0001")
def cov_exp(spark, d):
    c = stochastic.cov_columns("spatialcov(rho=0.05,q=1.5)", F.col("d"), F.lit(0.0), F.lit(0.0))
    return _pairs(spark, d, c=F.round(c, 9)).select("a", "b", "c")


@query("cov_sure", f"""WITH {_XY} SELECT a.k AS a, b.k AS b, round(0.5 * 4 * (pow(a.k + 1, 1.4) + pow(b.k + 1, 1.4) - pow(abs(a.k - b.k), 1.4)) * exp(-pow(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / 25, 2)), 6) AS c FROM xy a, xy b WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) < 8.0001""")
def cov_sure(spark, d):
    c = stochastic.cov_columns("sure(s2z=4,L=25,q=0.7,tref=1999)", F.col("d"), F.lit(2000.0) + F.col("a"), F.lit(2000.0) + F.col("b"))
    return _pairs(spark, d).select("a", "b", rounded_long(c, 6).alias("c"))


@query("cov_layers", f"""WITH {_XY} SELECT a.k AS a, b.k AS b, round(CASE WHEN a.k = b.k THEN 4.0 / 3 ELSE 0 END, 9) AS wn, round(CASE WHEN a.k = b.k THEN 1.5 ELSE 0 END + CASE WHEN a.k % 3 = b.k % 3 THEN 2 * exp(-sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / 9) ELSE 0 END + CASE WHEN a.x = b.x AND a.y = b.y THEN 3 * exp(-abs(a.k % 3 - b.k % 3) / 2.0) ELSE 0 END, 9) AS tud
FROM xy a, xy b WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) < 8.0001""")
def cov_layers(spark, d):
    t = lambda c: (F.col(c) % 3).cast("double")
    same = F.col("a") == F.col("b")
    wn = F.when(same, stochastic.cov_columns("WN(sigma=2,ndays=3)", F.col("d"), F.lit(0.0), F.lit(0.0))).otherwise(0.0)
    tud = stochastic.cov_columns("tudinsar4(s20=1.5,s2s=2,s2t=3,Rs=9,Rt=2)", F.col("d"), t("a"), t("b"), same)
    return _pairs(spark, d).select("a", "b", rounded_long(wn, 9).alias("wn"), rounded_long(tud, 9).alias("tud"))


_FREQ = [5.0, 12.0, 25.0, 60.0]


@query("lomb_scargle", f"""WITH {_E}, m AS (SELECT pnt, avg(value) AS ym, avg(dyear) AS t0, var_samp(value) AS v FROM e GROUP BY pnt), f AS (SELECT unnest({_FREQ}::DOUBLE[]) AS frequency),
x AS (SELECT e.pnt, frequency, 2 * pi() * frequency * (dyear - t0) AS a, value - ym AS y, v FROM e JOIN m USING (pnt), f), t AS (SELECT pnt, frequency, atan2(sum(sin(2 * a)), sum(cos(2 * a))) / 2 AS tau FROM x GROUP BY 1, 2)
SELECT x.pnt, x.frequency, round((pow(sum(y * cos(a - tau)), 2) / sum(pow(cos(a - tau), 2)) + pow(sum(y * sin(a - tau)), 2) / sum(pow(sin(a - tau), 2))) / 2 / any_value(v), 5) AS power FROM x JOIN t ON x.pnt = t.pnt AND x.frequency = t.frequency GROUP BY 1, 2""")
def lomb_scargle(spark, d):
    return rounded(series.periodogram(event_series(spark, d), _FREQ, ["pnt"], y="value"), 5)


@query("harmonic_lsq", f"""WITH {_E}, x AS (SELECT pnt, value AS y, cos(2 * pi() * 12 * (dyear - 2024)) AS c, sin(2 * pi() * 12 * (dyear - 2024)) AS s FROM e),
n AS (SELECT pnt, count(*) AS n, covar_pop(c, c) AS cc, covar_pop(c, s) AS cs, covar_pop(s, s) AS ss, covar_pop(c, y) AS cy, covar_pop(s, y) AS sy, avg(y) AS y, avg(c) AS mc, avg(s) AS ms FROM x GROUP BY pnt HAVING count(*) > 10)
SELECT pnt, n, round((ss * cy - cs * sy) / (cc * ss - cs * cs), 5) AS b_cos, round((cc * sy - cs * cy) / (cc * ss - cs * cs), 5) AS b_sin, round(y - mc * (ss * cy - cs * sy) / (cc * ss - cs * cs) - ms * (cc * sy - cs * cy) / (cc * ss - cs * cs), 5) AS mean FROM n""")
def harmonic_lsq(spark, d):
    e = event_series(spark, d)
    a = F.lit(2 * math.pi * 12) * (F.col("dyear") - 2024)
    x = e.select("pnt", F.col("value").alias("y"), F.cos(a).alias("c"), F.sin(a).alias("s"))
    g = x.groupBy("pnt").agg(F.count(F.lit(1)).alias("n"), *[F.covar_pop(*p).alias("".join(p)) for p in (("c", "c"), ("c", "s"), ("s", "s"), ("c", "y"), ("s", "y"))], *[F.avg(v).alias(f"m{v}") for v in "ycs"]).where("n > 10")
    det = F.col("cc") * F.col("ss") - F.col("cs") * F.col("cs")
    bc, bs = (F.col("ss") * F.col("cy") - F.col("cs") * F.col("sy")) / det, (F.col("cc") * F.col("sy") - F.col("cs") * F.col("cy")) / det
    return rounded(g.select("pnt", "n", bc.alias("b_cos"), bs.alias("b_sin"), (F.col("my") - F.col("mc") * bc - F.col("ms") * bs).alias("mean")), 5)


@query("series_parameters", f"""WITH {_E}, g AS (SELECT pnt, round(avg(dyear)) AS t0, regr_slope(value, dyear) AS b, regr_intercept(value, dyear) AS a, count(*) AS n FROM e GROUP BY pnt)
SELECT pnt::VARCHAR AS station, 'p(0)' AS par, round(a + b * t0, 3) AS estimate FROM g UNION ALL SELECT pnt::VARCHAR, 'p(1)', round(b, 3) FROM g""")
def series_parameters(spark, d):
    ts = event_series(spark, d).select(F.col("pnt").cast("string").alias("station"), F.lit("up").alias("component"), "dyear", F.col("value").alias("y"), F.lit(2.0).alias("sigma"))
    return rounded(series.parameters(ts, model="linear").select("station", "par", "estimate"), 3)


@query("series_components", f"""WITH {_E}, g AS (SELECT pnt, regr_slope(value, dyear) AS b, regr_intercept(value, dyear) AS a FROM e GROUP BY pnt) SELECT pnt::VARCHAR AS station, round(dyear, 8) AS dyear, round(a + b * dyear, 4) AS trend, round(value - a - b * dyear, 4) + 0.0 AS residual FROM e JOIN g USING (pnt)""")
def series_components(spark, d):
    ts = event_series(spark, d).select(F.col("pnt").cast("string").alias("station"), F.lit("up").alias("component"), "dyear", F.col("value").alias("y"), F.lit(2.0).alias("sigma"))
    c = series.components(ts, model="linear")
    return c.select("station", F.round("dyear", 8).alias("dyear"), F.round("trend", 4).alias("trend"), (F.round("residual", 4) + 0.0).alias("residual"))


@query("stm_difference", f"WITH c AS ({SQL_CAMPAIGN}), b AS (SELECT pnt, epoch, v * 0.9 AS v FROM c WHERE pnt % 2 = 0) SELECT c.pnt, c.epoch, round(c.v - b.v, 6) AS v FROM c JOIN b USING (pnt, epoch)")
def stm_difference(spark, d):
    c = campaign(spark, d).withColumn("obs_type", F.lit("Up"))
    b = c.where("pnt % 2 = 0").withColumn("v", F.col("v") * 0.9)
    return rounded(difference.difference(c, b).select("pnt", "epoch", "v"))


@query("reference_series", f"""WITH {SQL_REGIONS}, m AS (SELECT epoch, avg(v) AS m FROM c GROUP BY epoch) SELECT epoch, round(m - (SELECT median(m) FROM m), 6) + 0.0 AS xref FROM m""")
def reference_series(spark, d):
    """Reference terms of all quarters of a matrix without gaps: pair means in Spark, a small solve."""
    c = regions(spark, d)
    first = c.agg(F.min("epoch"), F.max("epoch")).first()
    x = transform.reference_series(c.withColumn("k", F.col("epoch") - first[0]), first[1] - first[0] + 1)
    return rounded(spark.createDataFrame([(int(first[0] + i), float(v)) for i, v in enumerate(x)], "epoch long, xref double"))


@query("difference_stats", f"""WITH {SQL_REGIONS}, d AS (SELECT pnt, epoch, v - 0.5 * v * (1 + pnt / 100.0::DOUBLE) AS v FROM c), r AS (SELECT pnt, avg(v) AS a FROM d GROUP BY pnt), e AS (SELECT epoch, avg(v - a) AS b FROM d JOIN r USING (pnt) GROUP BY epoch),
x AS (SELECT 'residual' AS part, v - a - b AS x FROM d JOIN r USING (pnt) JOIN e USING (epoch) UNION ALL SELECT 'offset', a FROM r UNION ALL SELECT 'transform', b FROM e)
SELECT part, round(min(x), 6) + 0.0 AS min, round(median(x), 6) + 0.0 AS median, round(max(x), 6) + 0.0 AS max, round(1.4826::DOUBLE * median(abs(x)), 6) AS mad, round(stddev_samp(x), 6) AS std, count(*) AS n FROM x GROUP BY part""")
def difference_stats(spark, d):
    """A matrix without gaps against a scaled one: residuals, epoch and point means after centering until it settles."""
    c = regions(spark, d).withColumn("obs_type", F.lit("Up"))
    other = c.withColumn("v", F.col("v") * 0.5 * (1 + F.col("pnt") / F.lit(100.0)))
    return rounded(difference.difference_stats(difference.difference(c, other)))


@query("integrate_small")
def integrate_small(spark, d):
    """Displacements of the simulated small scenario from five datasets."""
    obs, _ = simulate(spark, "small", range(2003, 2012), noise=1.0)
    return integrate.integrate(obs)[0]


@query("mht_select")
def mht_select(spark, d):
    """The displacement model of every customer's quarterly orders, among four."""
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("pnt"), (F.year("o_orderdate") * 4 + F.quarter("o_orderdate")).cast("int").alias("q"), "o_totalprice")
    span = o.agg(F.min("q"), F.max("q")).first()
    s = o.groupBy("pnt", (F.col("q") - span[0]).alias("epoch_idx")).agg((F.avg("o_totalprice") / 1e5).alias("v"))
    return testing.classify_points(s, [(span[0] + i) / 4 for i in range(span[1] - span[0] + 1)], [["constant"], ["constant", "linear"], ["constant", "linear", "heaviside"], ["constant", "periodic"]], ["WN(sigma=0.3)"], least=2)


@query("predict_grid")
def predict_grid(spark, d):
    """Velocities and signal of the simulated scenario on a grid, with error variances."""
    import numpy as np

    obs, true = simulate(spark, "small", range(2003, 2010), noise=0.5)
    t = true.join(obs.select("pnt", "epoch", "dyear", "n", "e").distinct(), ["pnt", "epoch"]).where("pnt < 20").orderBy("pnt", "epoch").toPandas()  # the simulation is small
    y, years = t.pivot(index="pnt", columns="epoch", values="up").to_numpy(), np.sort(t["dyear"].unique())
    xy = t.drop_duplicates("pnt")[["n", "e"]].to_numpy() / 1000
    fit = velocity.relative_velocities(y, years, refsystem="min-refseries")
    model = predict.Collocation(np.tile(xy, (len(years), 1)), np.repeat(years, len(xy)), fit["residuals"].T.ravel(), np.eye(y.size) * 0.25, "sure(s2z=1,L=5,q=0.7,tref=2002)")
    grid = spatial.output_grid(spark, (-10.0, -10.0, 10.0, 10.0), 5.0).crossJoin(spark.createDataFrame([(2005.0,), (2009.0,)], "t double"))
    p = len(xy)
    return predict.predict(grid, model, xy, fit["vel"], fit["qx"][:p, :p], fit["t0"])
