"""Group statistics and time-series windows over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from subsida.operators import aggregates as ag
from subsida.operators import windows as wn
from subsida.plans.bindings import SQL_CAMPAIGN, SQL_EVENTS, campaign, event_series, read, rounded
from subsida.plans.registry import query

_E = f"e AS ({SQL_EVENTS})"


@query("velocity_ols", f"""WITH {_E}, g AS (SELECT pnt, avg(dyear) AS t0, regr_slope(value, dyear) AS v, regr_intercept(value, dyear) AS c, count(*) AS n, regr_syy(value, dyear) - pow(regr_sxy(value, dyear), 2) / regr_sxx(value, dyear) AS sse FROM e GROUP BY pnt HAVING count(*) > 2)
SELECT pnt, n, round(t0, 6) AS t0, round(v, 2) AS vel, round(c + v * t0, 4) AS offset, round(sqrt(sse / (n - 2)), 4) AS rms FROM g""")
def velocity_ols(spark, d):
    from subsida.operators.velocity import velocities

    out = velocities(event_series(spark, d).withColumnRenamed("value", "v"), "dyear")
    return out.select("pnt", "n", F.round("t0", 6).alias("t0"), F.round("vel", 2).alias("vel"), F.round("offset", 4).alias("offset"), F.round("rms", 4).alias("rms"))


@query("velocity_top", f"""WITH {_E}, g AS (SELECT pnt, round(regr_slope(value, dyear), 2) AS vel FROM e GROUP BY pnt HAVING count(*) > 2) SELECT * FROM g ORDER BY abs(vel) DESC, pnt LIMIT 20""")
def velocity_top(spark, d):
    v = velocity_ols(spark, d).select("pnt", "vel")
    return ag.top_rejections(v, "vel", 0.0, 20, ["pnt"])


@query("group_stats", "SELECT s_nationkey AS nation, round(avg(s_acctbal), 6) AS mean, count(*) AS n, round(max(s_acctbal) - min(s_acctbal), 6) AS range, round(coalesce(stddev_samp(s_acctbal), 0), 6) AS std FROM supplier GROUP BY 1")
def group_stats(spark, d):
    return rounded(ag.group_stats(read(spark, d, "supplier").withColumnRenamed("s_nationkey", "nation"), "nation", "s_acctbal"))


_H = "h AS (SELECT user_id AS pnt, epoch_us(ts) / 3600000000.0::DOUBLE AS t, value AS v FROM events)"


def _hours(spark, d):
    return read(spark, d, "events").select(F.col("user_id").alias("pnt"), (F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), "ts") / 3600000000.0).alias("t"), F.col("value").alias("v"))


@query("daily_mean_bins", f"WITH {_H} SELECT pnt, ceil(t / 24)::BIGINT AS bin, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS std, count(*) AS n FROM h GROUP BY 1, 2")
def daily_mean_bins(spark, d):
    return rounded(ag.mean_bins(_hours(spark, d), 24.0, "v", ["pnt"]))


@query("median_mad_bins", f"WITH {_H} SELECT pnt, ceil(t / 72)::BIGINT AS bin, round(median(v), 6) AS median, round(1.4826::DOUBLE * mad(v), 6) AS mad, count(*) AS n FROM h GROUP BY 1, 2")
def median_mad_bins(spark, d):
    return rounded(ag.median_bins(_hours(spark, d), 72.0, "v", ["pnt"]))


@query("reduce_regimes", f"""WITH c AS ({SQL_CAMPAIGN}), l AS (SELECT epoch AS k, v, pnt % 3 AS regime, CASE WHEN pnt = epoch % 50 THEN 5 ELSE 1 END AS cls FROM c),
g AS (SELECT k, bool_or(cls = 5) AS alone, max(v) FILTER (WHERE cls = 5) AS v5, avg(v) FILTER (WHERE regime = 1) AS deep, avg(v) FILTER (WHERE regime = 2) AS total, count(*) FILTER (WHERE regime = 1) AS nd, count(*) FILTER (WHERE regime = 2) AS nt FROM l GROUP BY k)
SELECT k, round(CASE WHEN alone THEN v5 ELSE deep END, 6) AS deep, round(CASE WHEN NOT alone THEN total END, 6) AS total, CASE WHEN alone THEN 1 ELSE nd END::BIGINT AS n_deep, CASE WHEN alone THEN 0 ELSE nt END::BIGINT AS n_total,
  round(CASE WHEN NOT alone THEN total - deep END, 6) + 0.0 AS shallow FROM g WHERE alone OR nd > 0""")
def reduce_regimes(spark, d):
    """Suppliers as points, in three regimes; now and then one is a reflector."""
    c = campaign(spark, d).withColumn("regime", F.col("pnt") % 3).withColumn("pnt_class", F.when(F.col("pnt") == F.col("epoch") % 50, 5).otherwise(1))
    return rounded(ag.reduce_regimes(c.withColumnRenamed("epoch", "k"), ["k"]))


@query("nearest_epochs", f"""WITH {_H}, b AS (SELECT pnt, round(t / 120)::BIGINT AS bin, t - round(t / 120) * 120 AS dt, v FROM h), r AS (SELECT *, row_number() OVER (PARTITION BY pnt, bin ORDER BY abs(dt), dt) AS n FROM b WHERE abs(dt) < 48)
SELECT pnt, bin, round(avg(v), 6) AS v, count(*) AS n, round(avg(abs(dt)), 6) AS dt_mean FROM r WHERE n <= 3 GROUP BY 1, 2""")
def nearest_epochs(spark, d):
    h = _hours(spark, d).withColumn("bin", F.round(F.col("t") / 120).cast("long")).withColumn("dt", F.col("t") - F.col("bin") * 120)
    return rounded(ag.nearest_epochs(h, ["pnt", "bin"], "dt", 3, 48.0))


@query("pair_spread", f"WITH {_H}, p AS (SELECT a.pnt, abs(a.t - b.t) AS d FROM h a JOIN h b ON a.pnt = b.pnt AND a.t < b.t) SELECT pnt, (SELECT count(*) FROM h WHERE h.pnt = p.pnt) AS n, round(avg(d), 4) AS spread FROM p GROUP BY pnt")
def pair_spread(spark, d):
    return rounded(ag.mean_pair_distance(_hours(spark, d).withColumn("t", F.col("t") - 473000.0), ["pnt"], "t"), 4)


@query("mode_ties", "WITH c AS (SELECT c_nationkey AS k, length(c_mktsegment) AS s, count(*) AS n FROM customer GROUP BY 1, 2) SELECT k, arg_min(s, s)::INTEGER AS mode FROM c WHERE (k, n) IN (SELECT k, max(n) FROM c GROUP BY k) GROUP BY k")
def mode_ties(spark, d):
    return read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(ag.mode(F.length("c_mktsegment")).alias("mode"))


_COUNTS = """o AS (SELECT o_custkey AS pnt, (year(o_orderdate) * 4 + quarter(o_orderdate))::INTEGER AS epoch, o_orderkey % 4 AS dataset_id, ['north', 'east', 'up', 'asc', 'dsc'][(o_orderkey % 5 + 1)::INTEGER] AS kind FROM orders),
n AS (SELECT pnt, epoch, count(DISTINCT dataset_id) FILTER (WHERE kind = 'north') AS north, count(DISTINCT dataset_id) FILTER (WHERE kind = 'east') AS east, count(DISTINCT dataset_id) FILTER (WHERE kind = 'up') AS up,
 count(DISTINCT dataset_id) FILTER (WHERE kind = 'asc') AS asc_, count(DISTINCT dataset_id) FILTER (WHERE kind = 'dsc') AS dsc FROM o GROUP BY 1, 2)"""


def _typed(spark, d):
    kinds = F.array(*map(F.lit, ("north", "east", "up", "asc", "dsc")))
    o = read(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("pnt"), (F.year("o_orderdate") * 4 + F.quarter("o_orderdate")).alias("epoch"), (F.col("o_orderkey") % 4).alias("dataset_id"), F.get(kinds, (F.col("o_orderkey") % 5).cast("int")).alias("obs_type"))


def _counts(spark, d):
    return ag.observation_counts(_typed(spark, d), ["north", "east", "up", "asc", "dsc"])


@query("obs_counts", f'WITH {_COUNTS} SELECT pnt, epoch, north, east, up, asc_ AS "asc", dsc FROM n')
def obs_counts(spark, d):
    return _counts(spark, d)


def _staged(stages):
    """SQL of consecutive masked updates, each reading the one before."""
    cols, out, last = ("no", "ea", "up", "ne", "nu", "la", "ld"), [], "s0"
    for i, (cond, change) in enumerate(stages, 1):
        picks = ", ".join(f"CASE WHEN {cond} THEN {change[c]} ELSE {c} END AS {c}" if c in change else c for c in cols)
        out.append(f"s{i} AS (SELECT pnt, epoch, {picks} FROM {last})")
        last = f"s{i}"
    return ", ".join(out), last


_Z = {"la": "0.0::DOUBLE", "ld": "0.0::DOUBLE"}
_STAGES, _LAST = _staged([
    ("la > 0 AND ld > 0", {"ne": "least(la, ld)", "nu": "la + ld - least(la, ld)"} | _Z),
    ("ea > 0 AND up > 0", {"ne": "ne + (la + ld) / 3", "nu": "nu + (la + ld) * 2 / 3"} | _Z),
    ("ea > 0 AND up = 0", {"nu": "nu + la + ld"} | _Z),
    ("ea = 0 AND up > 0", {"ne": "ne + la + ld"} | _Z),
    ("no > 0", {"ea": "ea + ne", "up": "up + nu", "ne": "0.0::DOUBLE", "nu": "0.0::DOUBLE"}),
    ("no > 0 AND ea > 0", {"ea": "ea + (la + ld) / 3", "up": "up + (la + ld) * 2 / 3"} | _Z),
    ("up > 0", {"up": "up + nu", "nu": "0.0::DOUBLE"}),
    ("ea > 0", {"ea": "ea + ne", "ne": "0.0::DOUBLE"}),
])
_CAPS = f"""{_COUNTS}, s0 AS (SELECT pnt, epoch, north::DOUBLE AS no, east::DOUBLE AS ea, up::DOUBLE AS up, 0.0::DOUBLE AS ne, 0.0::DOUBLE AS nu, asc_::DOUBLE AS la, dsc::DOUBLE AS ld FROM n), {_STAGES},
caps AS (SELECT *, 2 * (la > 0)::INT + 3 * (ld > 0)::INT + 4 * (nu > 0)::INT + 7 * (up > 0)::INT AS sc_up, (la > 0 OR ld > 0)::INT + 4 * (ne > 0)::INT + 7 * (ea > 0)::INT AS sc_east, (la > 0 OR ld > 0 OR ne > 0 OR nu > 0)::INT + 7 * (no > 0)::INT AS sc_north FROM {_LAST})"""


@query("capability", f"WITH {_CAPS} SELECT pnt, epoch, round(no, 6) AS sp_north, round(ea, 6) AS sp_east, round(up, 6) AS sp_up, round(ne, 6) AS sp_near_east, round(nu, 6) AS sp_near_up, round(la, 6) AS sp_los_asc, round(ld, 6) AS sp_los_dsc, sc_north, sc_east, sc_up FROM caps")
def capability(spark, d):
    return rounded(ag.capabilities(_counts(spark, d)).select("pnt", "epoch", *[f"sp_{p}" for p in ag.PARAMETERS], "sc_north", "sc_east", "sc_up"))


def _label(c, name):
    picks = ", ".join(f"CASE WHEN bool_or(sc_{c} = {code}) THEN '{n}' END" for code, n in ((1, "under"), (2, "asc"), (3, "dsc"), (4, "near"), (7, "full")))
    return f"coalesce(nullif(concat_ws('/', {picks}), ''), 'no') || '{name}'"


@query("capability_labels", f"""WITH {_CAPS} SELECT pnt, {_label('north', 'North')} || ',' || {_label('east', 'East')} || ',' || {_label('up', 'Up')} AS capability,
 (bool_or(sc_north IN (2, 3, 4, 7)))::INT + (bool_or(sc_east IN (2, 3, 4, 7)))::INT + (bool_or(sc_up IN (2, 3, 4, 7)))::INT AS dim FROM caps GROUP BY pnt""")
def capability_labels(spark, d):
    return ag.capability_labels(ag.capabilities(_counts(spark, d)))


@query("redundancy", f"WITH {_COUNTS} SELECT pnt, sum(up)::BIGINT AS n, sum(greatest(up - 1, 0))::BIGINT AS rp, max(greatest(up - 1, 0))::BIGINT AS most FROM n GROUP BY pnt")
def redundancy(spark, d):
    return ag.redundancy(_counts(spark, d), "up", "pnt")


@query("dataset_histogram", f"WITH {_COUNTS}, c AS (SELECT pnt, epoch, count(DISTINCT dataset_id) AS n_datasets FROM o GROUP BY 1, 2) SELECT n_datasets, count(*) AS n FROM (SELECT pnt, count(DISTINCT dataset_id) AS n_datasets FROM o GROUP BY 1) GROUP BY 1")
def dataset_histogram(spark, d):
    return ag.dataset_histogram(_typed(spark, d), "pnt")


@query("total_counts", f"""WITH {_COUNTS}, p AS (SELECT dataset_id, count(*) AS m, count(DISTINCT pnt) AS np, count(DISTINCT epoch) AS ne FROM o GROUP BY 1)
SELECT sum(m)::BIGINT AS m, count(*) AS n_datasets, sum(np + ne)::BIGINT AS n_nuisance, count(*) AS rank_defect, 100::BIGINT AS n_parameters, (sum(m) - sum(np + ne) - 100 + count(*))::BIGINT AS redundancy FROM p""")
def total_counts(spark, d):
    return ag.totals(_typed(spark, d), F.lit(100).cast("long"))


@query("residual_stack", "SELECT hour(ts)::INTEGER AS unit, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, count(*) AS n FROM events GROUP BY 1")
def residual_stack(spark, d):
    return rounded(ag.residual_stack(read(spark, d, "events"), F.hour("ts"), "value"))


@query("common_mode", f"""WITH {_E}, s AS (SELECT pnt, avg(value) AS x, var_samp(value) / count(*) AS q FROM e GROUP BY pnt HAVING count(*) > 2) SELECT 1 AS par, round(sum(x / q) / sum(1 / q), 6) AS x, round(1 / sum(1 / q), 6) AS qxx, count(*) AS n FROM s""")
def common_mode(spark, d):
    s = event_series(spark, d).groupBy("pnt").agg(F.avg("value").alias("x"), (F.var_samp("value") / F.count(F.lit(1))).alias("qxx"), F.count(F.lit(1)).alias("n")).where("n > 2")
    return rounded(ag.common_mode(s.withColumn("par", F.lit(1)), ["par"]))


@query("two_way_center", f"""WITH c0 AS ({SQL_CAMPAIGN}), a1 AS (SELECT pnt, epoch, v - avg(v) OVER (PARTITION BY pnt) AS v FROM c0), b1 AS (SELECT pnt, epoch, v - avg(v) OVER (PARTITION BY epoch) AS v FROM a1),
a2 AS (SELECT pnt, epoch, v - avg(v) OVER (PARTITION BY pnt) AS v FROM b1), b2 AS (SELECT pnt, epoch, v - avg(v) OVER (PARTITION BY epoch) AS v FROM a2),
a3 AS (SELECT pnt, epoch, v - avg(v) OVER (PARTITION BY pnt) AS v FROM b2), b3 AS (SELECT pnt, epoch, v - avg(v) OVER (PARTITION BY epoch) AS v FROM a3) SELECT pnt, epoch, round(v, 5) + 0.0 AS v FROM b3""")
def two_way_center(spark, d):
    return rounded(ag.two_way_center(campaign(spark, d), rounds=3, eps=None).select("pnt", "epoch", "v"), 5)


@query("interval_stats", f"""WITH {_H}, g AS (SELECT pnt, lead(t) OVER (PARTITION BY pnt ORDER BY t) - t AS gap FROM h) SELECT pnt, round(min(gap), 5) AS min, round(avg(gap), 5) AS mean, round(median(gap), 5) AS median, round(max(gap), 5) AS max, round(coalesce(stddev_samp(gap), 0), 5) AS std,
 round(1.4826::DOUBLE * mad(gap), 5) AS mad FROM g WHERE gap IS NOT NULL GROUP BY pnt""")
def interval_stats(spark, d):
    return rounded(ag.interval_stats(_hours(spark, d), "t", ["pnt"]), 5)


@query("primary_points", f"""WITH c AS ({SQL_CAMPAIGN}), s AS (SELECT pnt, pnt % 7 AS cluster, count(*) AS n, max(epoch) - min(epoch) AS span FROM c GROUP BY pnt), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, span DESC, pnt) AS k FROM s) SELECT cluster, pnt, n, span FROM r WHERE k = 1""")
def primary_points(spark, d):
    s = campaign(spark, d).groupBy("pnt").agg(F.count(F.lit(1)).alias("n"), (F.max("epoch") - F.min("epoch")).alias("span")).withColumn("cluster", F.col("pnt") % 7)
    return ag.primary_points(s, "cluster", "n", "span", "pnt").select("cluster", "pnt", "n", "span")


_RES = f"""{_E}, f AS (SELECT pnt, regr_slope(value, dyear) AS b, regr_intercept(value, dyear) AS a, count(*) AS n, stddev_samp(value) AS s FROM e GROUP BY pnt HAVING count(*) > 2),
res AS (SELECT e.pnt, event_id, (value - a - b * dyear) / s AS w, pow((value - a - b * dyear) / s, 2) AS e2, 1 - 2.0 / n AS r FROM e JOIN f USING (pnt))"""


def _residuals(spark, d):
    from subsida.operators.velocity import velocities

    e = event_series(spark, d).withColumnRenamed("value", "v")
    s = e.groupBy("pnt").agg(F.stddev_samp("v").alias("s"))
    j = e.join(velocities(e, "dyear").select("pnt", "t0", "vel", "offset", "n"), "pnt").join(s, "pnt")
    w = (F.col("v") - F.col("offset") - F.col("vel") * (F.col("dyear") - F.col("t0"))) / F.col("s")
    return j.select("pnt", "event_id", w.alias("w"), (w * w).alias("e2"), (1 - 2.0 / F.col("n")).alias("r"))


@query("point_omt", f"WITH {_RES} SELECT pnt, round(sqrt(sum(e2) / sum(r)), 5) AS omt, round(sum(r), 5) AS dof, count(*) AS n FROM res GROUP BY pnt")
def point_omt(spark, d):
    return rounded(ag.model_tests(_residuals(spark, d), ["pnt"]), 5)


@query("topk_wtest", f"WITH {_RES} SELECT pnt, event_id, round(w, 5) AS w FROM res WHERE abs(w) > 2.5 ORDER BY abs(w) DESC, event_id LIMIT 50")
def topk_wtest(spark, d):
    return rounded(ag.top_rejections(_residuals(spark, d).select("pnt", "event_id", "w"), "w", 2.5, 50, ["event_id"]), 5)


@query("approx_redundancy", f"""WITH c AS ({SQL_CAMPAIGN}), r AS (SELECT *, 1 - 1.0 / count(*) OVER (PARTITION BY pnt) - 1.0 / count(*) OVER (PARTITION BY epoch) + 1.0 / count(*) OVER () AS r0 FROM c)
SELECT pnt, epoch, round(r0 * ((SELECT count(*) - count(DISTINCT pnt) - count(DISTINCT epoch) + 1 FROM c) / sum(r0) OVER ()), 6) AS r FROM r""")
def approx_redundancy(spark, d):
    return rounded(ag.approximate_redundancy(campaign(spark, d)).select("pnt", "epoch", "r"))


@query("empirical_sigma", f"WITH {_E}, x AS (SELECT pnt, value, value - lag(value) OVER (PARTITION BY pnt ORDER BY event_id) AS dv FROM e) SELECT pnt, round(coalesce(stddev_samp(dv), CASE WHEN count(dv) = 1 THEN 0 END) / sqrt(2), 5) AS emp, round(avg(value), 5) AS formal FROM x GROUP BY pnt")
def empirical_sigma(spark, d):
    return rounded(ag.empirical_sigma(event_series(spark, d), "pnt", "event_id", "value", "value").drop("factor"), 5)


@query("split_networks", """WITH e AS (SELECT o_custkey % 50 AS f, o_orderkey % 90 AS t, o_orderdate::DATE AS epoch FROM orders), o AS (SELECT epoch, count(DISTINCT f) AS n_origins FROM e GROUP BY 1),
b AS (SELECT epoch, count(*) AS n_double FROM (SELECT epoch, t FROM e GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1) SELECT epoch, n_origins, coalesce(n_double, 0) AS n_double FROM o LEFT JOIN b USING (epoch) WHERE n_origins > 1 OR n_double > 0""")
def split_networks(spark, d):
    return ag.split_networks(read(spark, d, "orders").select((F.col("o_custkey") % 50).alias("from_pnt"), (F.col("o_orderkey") % 90).alias("to_pnt"), F.to_date("o_orderdate").alias("epoch")))


@query("count_table", f"WITH c AS ({SQL_CAMPAIGN}) SELECT pnt, count(DISTINCT epoch) AS n_epochs, min(epoch) AS first, max(epoch) AS last, count(*) AS n FROM c GROUP BY pnt")
def count_table(spark, d):
    return ag.count_table(campaign(spark, d), ["pnt"])


_W = 5
_RMA = f"""{_E}, s AS (SELECT pnt, event_id, value AS y, row_number() OVER (PARTITION BY pnt ORDER BY event_id) AS i FROM e), c AS (SELECT pnt, max(i) AS n FROM s GROUP BY pnt),
a AS (SELECT pnt, event_id, i, y FROM s UNION ALL SELECT pnt, NULL, unnest(range({1 - _W}, 1)), NULL FROM c UNION ALL SELECT pnt, NULL, unnest(range(n + 1, n + {_W} + 1)), NULL FROM c),
m AS (SELECT *, median(y) OVER (PARTITION BY pnt ORDER BY i ROWS BETWEEN {_W} PRECEDING AND {_W} FOLLOWING) AS ym FROM a),
sy AS (SELECT pnt, 1.4826::DOUBLE * median(abs(y - ym)) AS sy FROM m WHERE y IS NOT NULL GROUP BY pnt),
v AS (SELECT p.pnt, p.event_id, p.i, p.y, p.ym, any_value(sy.sy) AS sy, count(*) FILTER (WHERE abs(p.y - q.ym) > sqrt(({_W} + 1.253::DOUBLE ** 2) / {_W}) * 2.5::DOUBLE * sy.sy) AS votes
  FROM m p JOIN m q ON p.pnt = q.pnt AND q.i BETWEEN p.i - {_W} AND p.i + {_W} JOIN sy ON p.pnt = sy.pnt WHERE p.y IS NOT NULL GROUP BY 1, 2, 3, 4, 5)"""


def _rma(spark, d):
    return wn.robust_moving_median(event_series(spark, d), "pnt", ["event_id"], "value", 2 * _W + 1, 2.5)


@query("robust_ma", f"WITH {_RMA} SELECT pnt, event_id, round(ym, 5) AS ym, round(sy, 5) AS sy, votes::INTEGER AS votes, votes > {_W} AS outlier FROM v")
def robust_ma(spark, d):
    return rounded(_rma(spark, d).select("pnt", "event_id", "ym", "sy", "votes", "outlier"), 5)


_STEP = f"""{_RMA}, z AS (SELECT pnt, event_id, i, CASE WHEN votes <= {_W} THEN y END AS y FROM v),
t AS (SELECT pnt, event_id, i, avg(y) OVER b AS mb, avg(y) OVER f AS mf, CASE WHEN count(y) OVER b = 1 THEN 0 ELSE stddev_samp(y) OVER b END AS sb, CASE WHEN count(y) OVER f = 1 THEN 0 ELSE stddev_samp(y) OVER f END AS sf FROM z
  WINDOW b AS (PARTITION BY pnt ORDER BY i ROWS BETWEEN {2 * _W + 1} PRECEDING AND 1 PRECEDING), f AS (PARTITION BY pnt ORDER BY i ROWS BETWEEN CURRENT ROW AND {2 * _W} FOLLOWING)),
u AS (SELECT pnt, event_id, i, CASE WHEN sb * sb + sf * sf > 0 THEN (mf - mb) / sqrt(sb * sb + sf * sf) END AS score FROM t)"""


@query("step_scores", f"""WITH {_STEP} SELECT pnt, event_id, round(score, 5) + 0.0 AS score, coalesce(abs(score) > 0.5 AND abs(score) > lag(abs(score), 1, 0.0::DOUBLE) OVER w AND abs(score) > lead(abs(score), 1, 0.0::DOUBLE) OVER w AND abs(score) > lag(abs(score), 2, 0.0::DOUBLE) OVER w AND abs(score) > lead(abs(score), 2, 0.0::DOUBLE) OVER w, false) AS is_step
FROM u WINDOW w AS (PARTITION BY pnt ORDER BY i)""")
def step_scores(spark, d):
    return rounded(wn.step_scores(_rma(spark, d), "pnt", 2 * _W + 1, 0.5).select("pnt", "event_id", "score", "is_step"), 5)


@query("moving_mean", f"""WITH {_RMA}, z AS (SELECT pnt, event_id, i, CASE WHEN votes <= {_W} THEN y END AS y FROM v) SELECT pnt, event_id, round(avg(y) OVER w, 5) AS ya, round(CASE WHEN count(y) OVER w = 1 THEN 0 ELSE stddev_samp(y) OVER w END, 5) AS sa FROM z
WINDOW w AS (PARTITION BY pnt ORDER BY i ROWS BETWEEN {_W} PRECEDING AND {_W} FOLLOWING)""")
def moving_mean(spark, d):
    return rounded(wn.moving_mean(_rma(spark, d), "pnt", 2 * _W + 1).select("pnt", "event_id", "ya", "sa"), 5)


@query("debias", f"""WITH {_E}, j AS (SELECT pnt, event_id, value, CASE WHEN event_id % 17 = 0 THEN coalesce(avg(value) OVER f - avg(value) OVER b, 0) ELSE 0 END AS jump FROM e
 WINDOW f AS (PARTITION BY pnt ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING), b AS (PARTITION BY pnt ORDER BY event_id ROWS BETWEEN 31 PRECEDING AND 1 PRECEDING))
SELECT pnt, event_id, round(value - sum(jump) OVER (PARTITION BY pnt ORDER BY event_id ROWS UNBOUNDED PRECEDING), 5) + 0.0 AS value FROM j""")
def debias(spark, d):
    e = event_series(spark, d).withColumn("brk", F.col("event_id") % 17 == 0)
    return rounded(wn.debias(e, "pnt", ["event_id"], "value", "brk").select("pnt", "event_id", "value"), 5)


@query("observed_span", f"WITH c AS ({SQL_CAMPAIGN}) SELECT pnt, min(epoch) AS first, max(epoch) AS last FROM c GROUP BY pnt")
def observed_span(spark, d):
    return wn.observed_span(campaign(spark, d))


@query("densify_epochs", f"""WITH {_H}, g AS (SELECT pnt, t, lead(t) OVER (PARTITION BY pnt ORDER BY t) - t AS gap FROM (SELECT DISTINCT pnt, t FROM h)), k AS (SELECT *, CASE WHEN gap > 12 THEN pow(2, ceil(log2(gap / 12))) ELSE 1 END::BIGINT AS parts FROM g),
x AS (SELECT pnt, t, gap, parts, unnest(range(parts)) AS j FROM k) SELECT pnt, round(t + coalesce(gap, 0) * j / parts, 5) AS t, j > 0 AS added FROM x""")
def densify_epochs(spark, d):
    return rounded(wn.densify(_hours(spark, d), 12.0, "t", ["pnt"]), 5)


@query("gap_sessions", f"""WITH {_H}, n AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY pnt ORDER BY t) > 6, false)::INT AS nw FROM h), s AS (SELECT *, sum(nw) OVER (PARTITION BY pnt ORDER BY t ROWS UNBOUNDED PRECEDING) AS session FROM n)
SELECT pnt, session::BIGINT AS session, round(avg(t), 5) AS t_mean, round(min(t), 5) AS first, round(max(t), 5) AS last, count(*) AS n FROM s GROUP BY 1, 2""")
def gap_sessions(spark, d):
    return rounded(wn.gap_sessions(_hours(spark, d), ["pnt"], "t", 6.0), 5)


_EV = "v AS (SELECT user_id AS station, CASE event_type WHEN 'click' THEN 'ANT' WHEN 'view' THEN 'REC' ELSE 'STEP' END AS type, round(epoch_us(ts) / 3600000000.0::DOUBLE - 473352, 0) AS year, event_id AS name FROM events)"


@query("trim_events", f"""WITH {_EV}, m AS (SELECT station, type, name, year AS y0, CASE WHEN type IN ('ANT', 'REC') AND year < 100 THEN 100 ELSE year END AS year FROM v),
k AS (SELECT *, lead(year) OVER (PARTITION BY station, type ORDER BY year, y0, name) AS nx FROM m), f AS (SELECT * FROM k WHERE (nx IS NULL OR nx <> year) AND year BETWEEN 100 AND 600),
r AS (SELECT *, row_number() OVER (PARTITION BY station, type ORDER BY year, y0, name) AS n FROM f) SELECT station, type, name, CASE WHEN n = 1 AND type IN ('ANT', 'REC') THEN 100.0 ELSE year END::DOUBLE AS year FROM r""")
def trim_events(spark, d):
    kind = F.when(F.col("event_type") == "click", "ANT").when(F.col("event_type") == "view", "REC").otherwise("STEP")
    hours = F.round(F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), "ts") / 3600000000.0 - 473352, 0)
    v = read(spark, d, "events").select(F.col("user_id").alias("station"), kind.alias("type"), hours.alias("year"), F.col("event_id").alias("name"))
    return wn.trim_events(v, 100.0, 600.0).select("station", "type", "name", "year")


@query("daily_grid", """WITH v AS (SELECT user_id AS pnt, ts::DATE AS day, avg(value) AS value FROM events GROUP BY 1, 2), g AS (SELECT pnt, unnest(generate_series((SELECT min(day) FROM v), (SELECT max(day) FROM v), INTERVAL 1 DAY))::DATE AS day FROM (SELECT DISTINCT pnt FROM v))
SELECT pnt, day, round(value, 6) AS value FROM g LEFT JOIN v USING (pnt, day)""")
def daily_grid(spark, d):
    v = event_series(spark, d).groupBy("pnt", F.to_date("ts").alias("day")).agg(F.avg("value").alias("value"))
    return rounded(wn.daily_grid(v, "pnt", "day", ["value"]))


@query("epoch_differences", f"WITH c AS ({SQL_CAMPAIGN}), k AS (SELECT *, epoch AS k FROM c) SELECT a.k, b.k AS l, round(avg(a.v - b.v), 5) + 0.0 AS y, count(*) AS n, round(count(*) / pow(a.k - b.k, 2), 6) AS w FROM k a JOIN k b ON a.pnt = b.pnt AND a.k > b.k GROUP BY 1, 2")
def epoch_differences(spark, d):
    c = campaign(spark, d).withColumn("k", F.col("epoch"))
    return rounded(rounded(wn.epoch_differences(c).withColumn("y", F.round("y", 5))))


@query("apply_transform", f"WITH c AS ({SQL_CAMPAIGN}), r AS (SELECT epoch, median(v) AS xref FROM c GROUP BY epoch), o AS (SELECT pnt, avg(v) AS xoff FROM c GROUP BY pnt) SELECT pnt, epoch, round(v - xref - xoff, 5) + 0.0 AS v FROM c JOIN r USING (epoch) JOIN o USING (pnt)")
def apply_transform(spark, d):
    c = campaign(spark, d)
    return rounded(wn.apply_transform(c, c.groupBy("epoch").agg(F.median("v").alias("xref")), c.groupBy("pnt").agg(F.avg("v").alias("xoff"))).select("pnt", "epoch", "v"), 5)


@query("epoch_ids", "WITH e AS (SELECT event_id, ts, 'E' || strftime(ts, '%Y%m%d') AS id, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y%m%d') ORDER BY ts) - 1 AS n FROM events) SELECT event_id, id || CASE WHEN n > 26 THEN chr((96 + (n - 1) // 26)::INTEGER) ELSE '' END || CASE WHEN n > 0 THEN chr((97 + (n - 1) % 26)::INTEGER) ELSE '' END AS epoch_id FROM e")
def epoch_ids(spark, d):
    e = read(spark, d, "events").select("event_id", "user_id", "ts")
    return wn.dyear_ids(e, "ts", by=["user_id"]).select("event_id", "epoch_id")
