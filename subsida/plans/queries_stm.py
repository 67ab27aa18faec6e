"""Matrices in wide form, masks of an integration, exports and weather over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from subsida.operators import aggregates as ag
from subsida.operators import filters, spatial
from subsida.operators import windows as wn
from subsida.plans.bindings import SQL_CAMPAIGN, campaign, read, rounded, suppliers
from subsida.plans.queries_series import _CAPS, _counts
from subsida.plans.registry import query
from subsida.sources import readers, sinks
from subsida.sources import stm as st

_YEARS = (1998, 1999, 2000)


@query("scan_pivot_stm", f"""WITH c AS ({SQL_CAMPAIGN}), y AS (SELECT pnt, epoch // 12 AS y, avg(v) AS v FROM c GROUP BY 1, 2) SELECT pnt, 'Up' AS obs_type, {', '.join(f'round(any_value(v) FILTER (WHERE y = {y}), 6) AS "{y}"' for y in _YEARS)} FROM y GROUP BY pnt""")
def scan_pivot_stm(spark, d):
    y = campaign(spark, d).groupBy("pnt", F.floor(F.col("epoch") / 12).alias("epoch")).agg(F.avg("v").alias("v")).withColumn("obs_type", F.lit("Up"))
    return rounded(st.wide(y, list(_YEARS)))


@query("unpivot_wide", f"""WITH c AS ({SQL_CAMPAIGN}), y AS (SELECT pnt, epoch // 12 AS y, avg(v) AS v FROM c GROUP BY 1, 2) SELECT pnt, y::BIGINT AS epoch, round(v, 6) AS v FROM y WHERE y IN {_YEARS}""")
def unpivot_wide(spark, d):
    wide = scan_pivot_stm(spark, d)
    long = wide.unpivot(["pnt"], [F.col(str(y)) for y in _YEARS], "epoch", "v").where("v is not null")
    return long.select("pnt", F.col("epoch").cast("long").alias("epoch"), "v")


@query("export_table", f"""WITH c AS ({SQL_CAMPAIGN}), y AS (SELECT pnt, epoch // 12 AS y, avg(v) AS v, var_samp(v) AS q FROM c GROUP BY 1, 2), w AS (SELECT pnt, {', '.join(f'any_value(v) FILTER (WHERE y = {y}) AS v{y}, any_value(q) FILTER (WHERE y = {y}) AS q{y}' for y in _YEARS)}, bool_or(v <> 0) AS any_value_set FROM y GROUP BY pnt)
SELECT s_name AS "ID", round(5.5::DOUBLE + ((pnt * 91) % 1000) / 1000.0::DOUBLE * 0.8::DOUBLE, 8) AS "Lon [deg]", round(53 + ((pnt * 37) % 1000) / 1000.0::DOUBLE * 0.6::DOUBLE, 8) AS "Lat [deg]", {', '.join(f'round(v{y}, 2) AS "{y} [mm]", round(sqrt(q{y}), 2) AS "std {y} [mm]"' for y in _YEARS)} FROM w JOIN supplier ON pnt = s_suppkey WHERE any_value_set""")
def export_table(spark, d):
    y = campaign(spark, d).groupBy("pnt", F.floor(F.col("epoch") / 12).alias("epoch")).agg(F.avg("v").alias("v"), F.var_samp("v").alias("var"))
    p = suppliers(spark, d).withColumnRenamed("k", "pnt").join(read(spark, d, "supplier").select(F.col("s_suppkey").alias("pnt"), F.col("s_name").alias("pnt_name")), "pnt")
    return sinks.export_table(p, y, [(y, float(y)) for y in _YEARS])


@query("integration_mask", f"""WITH {_CAPS}, a AS (SELECT c.pnt, c.epoch, sc_up AS sc, greatest(up - 1, 0) AS rp, (SELECT north + east + n.up + asc_ + dsc FROM n WHERE n.pnt = c.pnt AND n.epoch = c.epoch) AS n_datasets FROM caps c),
b AS (SELECT * FROM a WHERE pnt < 150 AND epoch BETWEEN 7980 AND 8010 AND pnt <> 3 AND epoch <> 7990 AND sc >= 2),
c1 AS (SELECT * FROM b WHERE epoch IN (SELECT epoch FROM b GROUP BY epoch HAVING max(n_datasets) >= 2) OR pnt = 5), c2 AS (SELECT * FROM c1 WHERE pnt IN (SELECT pnt FROM c1 GROUP BY pnt HAVING max(n_datasets) >= 2) OR pnt = 5),
c3 AS (SELECT * FROM c2 WHERE pnt IN (SELECT pnt FROM c2 GROUP BY pnt HAVING count(*) >= 3) OR pnt = 5) SELECT pnt, epoch, sc FROM c3 WHERE epoch IN (SELECT epoch FROM c3 GROUP BY epoch HAVING count(*) >= 10) OR pnt = 5""")
def integration_mask(spark, d):
    c = ag.capabilities(_counts(spark, d))
    caps = c.select("pnt", "epoch", F.col("pnt").cast("double").alias("lat"), F.lit(0.0).alias("lon"), F.col("epoch").cast("double").alias("dyear"), (F.col("north") + F.col("east") + F.col("up") + F.col("asc") + F.col("dsc")).alias("n_datasets"), F.col("sc_up").alias("sc"), F.greatest(F.col("sp_up") - 1, F.lit(0.0)).alias("rp"))
    return filters.integration_mask(caps, (0.0, -1.0, 149.5, 1.0), [(7980.0, 8010.0)], [3], [7990], 2, 2, [5], False, 3, 10, 2).select("pnt", "epoch", "sc")


@query("terrain_join", "SELECT p_partkey::VARCHAR AS pnt_name, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size::DOUBLE END AS terrain FROM part")
def terrain_join(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("pnt_name"), "p_size")
    t = p.select("pnt_name", F.when(F.col("p_size") % 5 == 0, -327.7).otherwise(F.col("p_size").cast("double")).alias("terrain"))
    return readers.join_terrain(p.select("pnt_name"), t)


@query("daily_meteo", "SELECT event_type AS station, ts::DATE AS day, round(avg(value), 6) AS t, round(avg(value * 0.1), 6) AS p FROM events GROUP BY 1, 2")
def daily_meteo(spark, d):
    h = read(spark, d, "events").select(F.col("event_type").alias("station"), F.to_date("ts").alias("day"), F.col("value").alias("t"), (F.col("value") * 0.1).alias("p"))
    return rounded(readers.daily_meteo(h))


@query("common_points", f"""WITH c AS ({SQL_CAMPAIGN}) SELECT pnt FROM c WHERE epoch % 12 = 0 INTERSECT SELECT pnt FROM c WHERE epoch % 12 = 6""")
def common_points(spark, d):
    c = campaign(spark, d)
    return c.where("epoch % 12 = 0").select("pnt").intersect(c.where("epoch % 12 = 6").select("pnt"))


@query("excluded_points", f"WITH c AS ({SQL_CAMPAIGN}) SELECT DISTINCT pnt FROM c WHERE pnt NOT IN (SELECT pnt FROM c WHERE v > 11.47)")
def excluded_points(spark, d):
    c = campaign(spark, d)
    return c.select("pnt").distinct().join(c.where("v > 11.47").select("pnt"), "pnt", "left_anti")


@query("head_and_tail", f"""WITH c AS ({SQL_CAMPAIGN}), n AS (SELECT pnt, count(DISTINCT epoch) AS n_epochs, min(epoch) AS first, max(epoch) AS last, count(*) AS n FROM c GROUP BY pnt), a AS (SELECT * FROM n ORDER BY n DESC, pnt LIMIT 10), b AS (SELECT * FROM n ORDER BY n, pnt DESC LIMIT 10) SELECT * FROM a UNION SELECT * FROM b""")
def head_and_tail(spark, d):
    return ag.head_and_tail(ag.count_table(campaign(spark, d), ["pnt"]), "n", "pnt", 20)


@query("component_outliers")
def component_outliers(spark, d):
    """Samples of a user that are outliers in value or in its hour."""
    e = read(spark, d, "events").select(F.col("user_id").alias("pnt"), "event_id", "value", F.hour("ts").cast("double").alias("hour"))
    return wn.component_outliers(e, "pnt", ["event_id"], ["value", "hour"], 11, 2.5)


@query("distance_cluster_table", f"""WITH RECURSIVE xy AS (SELECT s_suppkey AS k, (53 + ((s_suppkey * 37) % 1000) / 1000.0::DOUBLE * 0.6::DOUBLE) * 110.0 AS x, (5.5::DOUBLE + ((s_suppkey * 91) % 1000) / 1000.0::DOUBLE * 0.8::DOUBLE) * 66.0 AS y FROM supplier),
l AS (SELECT a.k AS a, b.k AS b FROM xy a, xy b WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) < 3.3001), r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a), c AS (SELECT a AS k, min(b) AS cluster FROM r GROUP BY a)
SELECT cluster, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM c JOIN xy USING (k) GROUP BY cluster""")
def distance_cluster_table(spark, d):
    p = suppliers(spark, d).select("k", (F.col("lat") * 110.0).alias("x"), (F.col("lon") * 66.0).alias("y"))
    return rounded(spatial.cluster_table(p, spatial.distance_clusters(p, 3.3001, "k"), "k", ["x", "y"]))
