"""Matrices on disk, index lookups, merges, masks, stacks and covariances over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from subsida.functions import geo, rdnap, stochastic
from subsida.operators import aggregates as ag
from subsida.operators import filters, joins, series
from subsida.operators import windows as wn
from subsida.operators.storage import shared_dir
from subsida.plans.bindings import SQL_CAMPAIGN, SQL_EVENTS, SQL_SUPPLIERS, campaign, event_series, read, rounded, suppliers
from subsida.plans.registry import query
from subsida.sources import stm as st

_C = f"c AS ({SQL_CAMPAIGN})"


def _matrix(spark, d) -> st.Stm:
    """The campaign as a matrix of its own schema, missing columns null."""
    shape = {k: [c.split() for c in st.SCHEMAS[k].split(", ")] for k in ("points", "epochs", "obs")}
    lay = lambda df, k: df.select([(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in shape[k]])
    c = campaign(spark, d).withColumn("dataset_id", F.lit("lev")).withColumn("obs_type", F.lit("Up"))
    p = c.select("dataset_id", "pnt").distinct().withColumn("pnt_name", F.concat(F.lit("P"), "pnt"))
    e = c.select("dataset_id", "epoch").distinct().withColumn("dyear", F.col("epoch") / 12)
    return st.create(spark, "lev", "lev", points=lay(p, "points"), epochs=lay(e, "epochs"), obs=lay(c, "obs"))


def _written(spark, d) -> str:
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/matrix-{uuid.uuid4().hex}"
    st.write(_matrix(spark, d), path)
    return path


@query("matrix_round_trip", f"WITH {_C} SELECT 'lev' AS dataset_id, pnt, epoch, 'Up' AS obs_type, round(v, 6) AS v FROM c")
def matrix_round_trip(spark, d):
    """Observations written as a matrix and read again."""
    return rounded(st.read(spark, _written(spark, d))["obs"].select("dataset_id", F.col("pnt").cast("long").alias("pnt"), F.col("epoch").cast("long").alias("epoch"), "obs_type", "v"))


@query("matrix_partial_read", f"WITH {_C} SELECT pnt, epoch, round(v, 6) AS v FROM c WHERE pnt IN (1, 3, 5, 7) AND epoch BETWEEN 23976 AND 23987")
def matrix_partial_read(spark, d):
    """The same, of four points and one year."""
    m = st.read(spark, _written(spark, d), points=[1, 3, 5, 7], epochs=list(range(23976, 23988)))
    return rounded(m["obs"].select(F.col("pnt").cast("long").alias("pnt"), F.col("epoch").cast("long").alias("epoch"), "v"))


@query("matrix_without_data", f"WITH {_C} SELECT 'P' || pnt AS pnt_name, 0::BIGINT AS n_obs FROM c GROUP BY pnt")
def matrix_without_data(spark, d):
    """Points of a matrix that is read without its data."""
    m = st.read(spark, _written(spark, d), "NODATA")
    n = m["obs"].agg(F.count(F.lit(1)).alias("n_obs"))
    return m["points"].select("pnt_name").crossJoin(F.broadcast(n))


@query("matrix_patch", f"WITH {_C} SELECT pnt, epoch, round(CASE WHEN epoch % 12 = 0 THEN -1 ELSE v END, 6) AS v FROM c")
def matrix_patch(spark, d):
    """Observations of every January replaced in place."""
    path = _written(spark, d)
    old = st.read(spark, path)["obs"]
    st.patch(spark, path, old.where("epoch % 12 = 0").withColumn("v", F.lit(-1.0)))
    return rounded(st.read(spark, path)["obs"].select(F.col("pnt").cast("long").alias("pnt"), F.col("epoch").cast("long").alias("epoch"), "v"))


@query("index_lookup", "SELECT o_orderkey, c_nationkey AS target FROM orders JOIN customer ON o_custkey = c_custkey")
def index_lookup(spark, d):
    obs = read(spark, d, "orders").select(F.lit("a").alias("dataset_id"), F.col("o_custkey").alias("idx"), "o_orderkey")
    xref = read(spark, d, "customer").select(F.lit("a").alias("dataset_id"), F.col("c_custkey").alias("idx"), F.col("c_nationkey").alias("target"))
    return joins.by_index(obs, xref, "idx", "target").select("o_orderkey", "target")


_XYS = "SELECT k, lat * 110.0 AS x, lon * 66.0 AS y FROM ({}) p"


@query("evaluate_by_distance", f"""WITH s AS ({_XYS.format(SQL_SUPPLIERS)}), g AS (SELECT k, x + 0.4::DOUBLE AS x, y - 0.3::DOUBLE AS y FROM s), c AS (SELECT g.k, s.k AS near_s, sqrt((g.x - s.x) ** 2 + (g.y - s.y) ** 2) AS d FROM g, s),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(d, 9), near_s) AS n FROM c WHERE d < 2.0001) SELECT k, near_s, round(d, 6) AS d FROM r WHERE n = 1""")
def evaluate_by_distance(spark, d):
    s = suppliers(spark, d).select("k", (F.col("lat") * 110.0).alias("x"), (F.col("lon") * 66.0).alias("y"))
    g = s.select("k", (F.col("x") + 0.4).alias("x"), (F.col("y") - 0.3).alias("y"))
    return rounded(joins.nearest_in_space(g, s.withColumnRenamed("k", "s"), 2.0001, "k", "s").select("k", "near_s", "d"))


_HOURS = "epoch_us(ts) / 3600000000.0::DOUBLE"


@query("reduce_epochs", f"""WITH e AS (SELECT event_id, user_id AS g, {_HOURS} AS t FROM events), v AS (SELECT g, (t0 * 48)::BIGINT AS ev, t0 * 48.0::DOUBLE AS t FROM (SELECT g, unnest(range((min(t) / 48)::BIGINT, (max(t) / 48)::BIGINT)) AS t0 FROM e GROUP BY g)),
c AS (SELECT v.g, ev, event_id, abs(v.t - e.t) AS dt FROM v JOIN e ON v.g = e.g), r AS (SELECT *, row_number() OVER (PARTITION BY g, ev ORDER BY dt, event_id) AS n FROM c) SELECT g, ev, event_id AS near_event_id, round(dt, 6) AS dt FROM r WHERE n = 1""")
def reduce_epochs(spark, d):
    """The nearest sample of every second day, station by station; equal evaluation times of stations don't mix."""
    e = read(spark, d, "events").select("event_id", F.col("user_id").alias("g"), (F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), "ts") / 3600000000.0).alias("t"))
    span = e.groupBy("g").agg(F.round(F.min("t") / 48).cast("long").alias("a"), F.round(F.max("t") / 48).cast("long").alias("b")).where("b > a")
    v = span.select("g", F.explode(F.sequence("a", F.col("b") - 1)).alias("n")).select("g", (F.col("n") * 48).alias("ev"), (F.col("n") * 48.0).alias("t"))
    return rounded(joins.nearest_in_time(v, e, "ev", "event_id", "t", None, ["g"]).select("g", "ev", "near_event_id", "dt"))


@query("matched_means", "SELECT DISTINCT lat, lon FROM (SELECT round(avg(s_nationkey), 6) AS lat, round(avg(s_acctbal), 6) AS lon FROM supplier GROUP BY s_nationkey)")
def matched_means(spark, d):
    return rounded(ag.matched_means(read(spark, d, "supplier").select(F.col("s_nationkey").alias("m"), F.col("s_nationkey").cast("double").alias("lat"), F.col("s_acctbal").alias("lon")), "m", ["lat", "lon"]))


@query("stack_hour_of_month", "SELECT ((day(ts) - 1) * 24 + hour(ts))::INTEGER AS unit, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, count(*) AS n FROM events GROUP BY 1")
def stack_hour_of_month(spark, d):
    return rounded(ag.residual_stack(read(spark, d, "events"), (F.dayofmonth("ts") - 1) * 24 + F.hour("ts"), "value"))


@query("drop_synthetic", "SELECT s_suppkey AS k, CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE s_name END AS name FROM supplier WHERE s_nationkey <> 3 AND s_suppkey % 5 <> 0")
def drop_synthetic(spark, d):
    k = F.col("s_suppkey")
    p = read(spark, d, "supplier").select(k.alias("k"), F.when(k % 5 == 0, "SYN_BM").when(k % 7 != 0, F.col("s_name")).alias("name"), F.when(F.col("s_nationkey") != 3, 53.0).alias("lat"), F.lit(6.0).alias("lon"))
    return filters.drop_synthetic(p).select("k", F.coalesce("name", F.lit("")).alias("name"))


@query("height_only", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount > 0 AND l_tax <> 0.04 GROUP BY ALL")
def height_only(spark, d):
    flat = F.col("l_tax") != 0.04
    li = read(spark, d, "lineitem").where("l_discount > 0 or l_tax = 0.04").select("l_orderkey", "l_linenumber", F.when(flat, 0.0).otherwise(0.7).alias("s_north"), F.lit(0.0).alias("s_east"), F.when(flat, 1.0).otherwise(0.0).alias("s_up"))
    return filters.height_only(li).select("l_orderkey", "l_linenumber").distinct()


@query("precise", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_discount <= 0.05 OR l_discount IS NULL) AND (l_tax <= 0.05 OR l_tax IS NULL)")
def precise(spark, d):
    return filters.precise(read(spark, d, "lineitem"), ["l_discount", "l_tax"], 0.05).select("l_orderkey", "l_linenumber", "l_partkey")


@query("headings", "SELECT s_suppkey AS k, ((s_suppkey * 77 - 400) % 360 + 360) % 360 AS heading, CASE s_nationkey % 3 WHEN 0 THEN 'Asc' WHEN 1 THEN 'Dsc' ELSE 'other' END AS mode FROM supplier")
def headings(spark, d):
    s = read(spark, d, "supplier")
    spelled = F.when(F.col("s_nationkey") % 3 == 0, "ASCENDING").when(F.col("s_nationkey") % 3 == 1, "dsc").otherwise("other")
    return s.select(F.col("s_suppkey").alias("k"), filters.normal_heading((F.col("s_suppkey") * 77 - 400).cast("double")).cast("long").alias("heading"), filters.lookup(spelled, {"ascending": "Asc", "asc": "Asc", "descending": "Dsc", "dsc": "Dsc"}).alias("mode"))


@query("union_and_unique", "SELECT DISTINCT round(c_acctbal, -2) + 0.0 AS t FROM (SELECT c_acctbal FROM customer UNION ALL SELECT s_acctbal FROM supplier) ORDER BY t")
def union_and_unique(spark, d):
    both = read(spark, d, "customer").select(F.col("c_acctbal").alias("t")).unionByName(read(spark, d, "supplier").select(F.col("s_acctbal").alias("t")))
    return both.select((F.round("t", -2) + F.lit(0.0)).alias("t")).distinct().orderBy("t")


@query("add_event", "SELECT user_id::VARCHAR AS station, event_type AS type, event_id::DOUBLE AS year, 'x' AS name FROM events UNION ALL SELECT 'new', 'STEP', 2020.5, 'added'")
def add_event(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").cast("string").alias("station"), F.col("event_type").alias("type"), F.col("event_id").cast("double").alias("year"), F.lit("x").alias("name"))
    return wn.add_event(e, {"station": "new", "type": "STEP", "year": 2020.5, "name": "added"})


@query("step_corrected", f"""WITH e AS ({SQL_EVENTS}), n AS (SELECT pnt, event_id, value AS y, row_number() OVER (PARTITION BY pnt ORDER BY event_id) AS i, event_id % 13 = 0 AS outlier, event_id % 50 = 0 AS s FROM e),
l AS (SELECT *, sum(CASE WHEN s THEN 5.0::DOUBLE ELSE 0 END) OVER (PARTITION BY pnt ORDER BY i) AS level FROM n)
SELECT pnt, event_id, round(avg(CASE WHEN NOT outlier THEN y - level END) OVER (PARTITION BY pnt ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) + level, 5) AS ys FROM l""")
def step_corrected(spark, d):
    n = wn.numbered(event_series(spark, d), "pnt", ["event_id"], "value")
    flagged = n.withColumn("outlier", F.col("event_id") % 13 == 0).withColumn("is_sed", F.col("event_id") % 50 == 0).withColumn("step", F.lit(5.0))
    return rounded(wn.step_corrected(flagged, "pnt", 7).select("pnt", "event_id", "ys"), 5)


@query("ellipsoidal_neu", f"""WITH p AS ({SQL_SUPPLIERS}), r AS (SELECT k, radians(lat) AS f, radians(lon) AS l, radians(53.3::DOUBLE) AS f0, radians(6.0::DOUBLE) AS l0, 6378137.0::DOUBLE AS a, (2 - 1 / 298.257223563::DOUBLE) / 298.257223563::DOUBLE AS e2 FROM p),
x AS (SELECT k, f0, l0, (a / sqrt(1 - e2 * sin(f) ** 2) + 20) * cos(f) * cos(l) - (a / sqrt(1 - e2 * sin(f0) ** 2)) * cos(f0) * cos(l0) AS dx, (a / sqrt(1 - e2 * sin(f) ** 2) + 20) * cos(f) * sin(l) - (a / sqrt(1 - e2 * sin(f0) ** 2)) * cos(f0) * sin(l0) AS dy,
  (a * (1 - e2) / sqrt(1 - e2 * sin(f) ** 2) + 20) * sin(f) - (a * (1 - e2) / sqrt(1 - e2 * sin(f0) ** 2)) * sin(f0) AS dz FROM r)
SELECT k, round(-sin(f0) * cos(l0) * dx - sin(f0) * sin(l0) * dy + cos(f0) * dz, 3) AS n, round(-sin(l0) * dx + cos(l0) * dy, 3) AS e, round(cos(f0) * cos(l0) * dx + cos(f0) * sin(l0) * dy + sin(f0) * dz, 3) AS u FROM x""")
def ellipsoidal_neu(spark, d):
    """Local cartesian coordinates about a point."""
    p = suppliers(spark, d)
    v = geo.plh_to_neu_cartesian(F.col("lat"), F.col("lon"), F.lit(20.0), F.lit(53.3), F.lit(6.0), F.lit(0.0))
    return rounded(p.select("k", v.alias("v")).select("k", "v.n", "v.e", "v.u"), 3)


@query("national_grid_round_trip", f"SELECT k, round(lat, 6) AS lat, round(lon, 6) AS lon FROM ({SQL_SUPPLIERS}) p")
def national_grid_round_trip(spark, d):
    """To the national grid and back again."""
    p = suppliers(spark, d).withColumn("rd", rdnap.etrs_to_rd(F.col("lat"), F.col("lon"), F.lit(0.0))).withColumn("b", rdnap.bessel_height(F.col("lat"), F.col("lon"), F.lit(0.0)))
    back = rdnap.rd_to_etrs(F.col("rd.x"), F.col("rd.y"), F.col("b"))
    return rounded(p.withColumn("g", back).select("k", "g.lat", "g.lon"))


@query("temporal_covariances", """WITH t AS (SELECT unnest(range(12)) AS i), p AS (SELECT a.i AS i, b.i AS j, abs(a.i - b.i) AS lag FROM t a, t b)
SELECT i, j, round(4.0 * exp(-0.5 * lag), 9) AS fogm, CASE WHEN lag = 0 THEN 4.0 ELSE 0.0 END::DOUBLE AS pl0 FROM p""")
def temporal_covariances(spark, d):
    """First-order Gauss-Markov noise in closed form, and power-law noise of index 0, which is white."""
    t = [2000 + (i + 0.25) / 365.25 for i in range(12)]
    fogm, flat = (stochastic.temporal(*stochastic.parse(m), t) for m in ("FOGM(rho=0.5,sigma=2,fs=1)", "PL(alpha=0,sigma=2,fs=1)"))
    rows = [(i, j, float(fogm[i, j]), float(flat[i, j])) for i in range(12) for j in range(12)]
    return rounded(spark.createDataFrame(rows, "i long, j long, fogm double, pl0 double"), 9)


@query("station_summary", f"WITH e AS ({SQL_EVENTS}) SELECT pnt::VARCHAR AS station, 'up' AS component, round(regr_slope(value, dyear), 3) AS vel, count(*) AS n FROM e GROUP BY pnt")
def station_summary(spark, d):
    ts = event_series(spark, d).select(F.col("pnt").cast("string").alias("station"), F.lit("up").alias("component"), "dyear", F.col("value").alias("y"), F.lit(2.0).alias("sigma"))
    return rounded(series.summary(series.parameters(ts, model="linear")).select("station", "component", "vel", F.col("n").cast("long").alias("n")), 3)


@query("common_mode_removed", f"WITH e AS ({SQL_EVENTS}), r AS (SELECT *, day(ts) AS dyear_, avg(value) OVER (PARTITION BY day(ts)) AS cm FROM e) SELECT event_id, round(value - cm, 6) + 0.0 AS residual, round(cm, 6) AS cm FROM r")
def common_mode_removed(spark, d):
    c = event_series(spark, d).select("event_id", F.lit("up").alias("component"), F.dayofmonth("ts").alias("dyear"), F.col("value").alias("residual"))
    return rounded(series.remove_common_mode(c).select("event_id", "residual", "cm"))
