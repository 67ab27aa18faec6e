"""The processing modules as lazy plans: import, selection, reduction, decomposition, velocity, export.

Each module takes and returns Stm objects or tables; what it plans runs when its result is written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subsida.functions import geo
from subsida.functions import time as tm
from subsida.operators import aggregates as ag
from subsida.operators import filters, joins, series, spatial, testing
from subsida.operators import windows as wn
from subsida.sources import readers
from subsida.sources import stm as st
from subsida.sources.options import merge

# --- imports -----------------------------------------------------------------


@dataclass
class LevellingOptions:
    poi: tuple = ()
    include: tuple = ()
    exclude: tuple = ()
    flags: tuple = ()
    min_observations: int = 1
    drop_split: bool = False


def levelling_to_stm(spark: SparkSession, dataset_id: str, points: DataFrame, edges: DataFrame, options=None) -> st.Stm:
    """Points (pnt, pnt_name, lat, lon, h) and edges (readers.EDGES with dyear) to a matrix; the origin of an epoch is 0, values are mm."""
    opt = merge(LevellingOptions(), options)
    e = edges.where(filters.in_periods(F.col("dyear"), list(opt.poi)))
    e = filters.select_projects(e, "project", list(opt.include), list(opt.exclude), list(opt.flags), "sd_flag")
    e = filters.height_only(e)
    if opt.drop_split:
        e = ag.split_networks(e, "dyear", drop=True)
    p = filters.drop_synthetic(points, "pnt_name")
    kept = p.join(filters.enough_observations(e, opt.min_observations, epoch="dyear").select("pnt"), "pnt", "left_semi")
    e = e.join(kept.select(F.col("pnt").alias("to_pnt")), "to_pnt", "left_semi")
    e = filters.reindex(e, "dyear", "epoch")
    values = e.select(F.col("to_pnt").alias("pnt"), "epoch", (F.col("sd_obs") * 1e3).alias("v"))
    origins = e.select(F.col("from_pnt").alias("pnt"), "epoch", F.lit(0.0).alias("v")).distinct()
    obs = values.unionByName(origins).select(F.lit(dataset_id).alias("dataset_id"), "pnt", "epoch", F.lit("Up").alias("obs_type"), "v")
    eps = e.select("epoch", "dyear").distinct().select(F.lit(dataset_id).alias("dataset_id"), "epoch", F.format_string("%.2f", "dyear").alias("epoch_id"), "dyear", F.lit(None).cast("map<string,string>").alias("attrs"))
    return st.create(spark, dataset_id, "lev", points=_points(kept, dataset_id), epochs=eps, obs=obs)


def _points(p: DataFrame, dataset_id: str) -> DataFrame:
    """Point table in full, with local coordinates around the box's centre."""
    have = {"pnt_id": F.lit(None).cast("string"), "h": F.lit(0.0), "attrs": F.lit(None).cast("map<string,string>")}
    p = p.withColumns({k: v for k, v in have.items() if k not in p.columns})
    q = p.crossJoin(F.broadcast(geo.bbox_centre(p)))  # one row
    neu = geo.plh_to_neu(F.col("lat"), F.col("lon"), F.col("h"), F.col("lat0"), F.col("lon0"), F.col("h0"))
    return q.select(F.lit(dataset_id).alias("dataset_id"), "pnt", "pnt_name", "pnt_id", "lat", "lon", "h", neu["n"].alias("n"), neu["e"].alias("e"), "attrs")


def gnss_to_daily(samples: DataFrame, least: int = 20, crit: float = 0.0005, longest: int = 18, aliases: DataFrame | None = None) -> DataFrame:
    """(station, day, dyear, n_mm, e_mm, u_mm, cnt) from hourly samples (station, row, ts, lat, lon, h).

    Samples out of order go, stretches of stuck coordinates are left out, days need `least` samples; values are mm from the station's first sample.
    """
    s = filters.ordered_times(samples, "station", "row", "ts")
    first = s.groupBy("station").agg(*[F.min_by(c, "ts").alias(f"{c}0") for c in ("lat", "lon", "h")])
    s = s.join(first, "station")
    neu = geo.plh_to_neu_ellipsoidal(F.col("lat"), F.col("lon"), F.col("h"), F.col("lat0"), F.col("lon0"), F.col("h0"))
    s = s.withColumn("x", neu).select("station", "ts", F.col("x.n").alias("n"), F.col("x.e").alias("e"), F.col("x.u").alias("u"))
    stuck = filters.stuck_intervals(s, "station", "ts", ["n", "e"], crit, longest).select(F.col("station").alias("__s"), F.col("first").alias("__a"), F.col("last").alias("__b"))
    s = s.join(stuck, (F.col("station") == F.col("__s")) & F.col("ts").between(F.col("__a"), F.col("__b")), "left_anti")
    daily = filters.complete_days(s.withColumn("day", F.to_date("ts")), ["station", "day"], ["n", "e", "u"], least, "cnt")
    if aliases is not None:
        daily = filters.rename_stations(daily, aliases)
    noon = tm.mjd_to_dyear(F.datediff("day", F.lit("1970-01-01").cast("date")) + tm.MJD_1970 + F.lit(0.5))
    return daily.select("station", "day", noon.alias("dyear"), *[(F.col(c) * 1000).alias(f"{c}_mm") for c in ("n", "e", "u")], "cnt")


def insar_to_stm(spark: SparkSession, dataset_id: str, path: str, heading: float, terrain: DataFrame | None = None, threshold: float = 3.0, names: dict[str, str] | None = None) -> st.Stm:
    """A wide InSAR file to a matrix: sensitivities from incidence and heading, regimes from terrain heights.

    names maps pnt_name, lat, lon, h and inc to the file's columns.
    """
    n = names or {"pnt_name": "pnt_id", "lat": "pnt_lat", "lon": "pnt_lon", "h": "pnt_height", "inc": "pnt_incidence_angle"}
    raw, obs = readers.insar_csv(spark, path)
    p = raw.select(*[F.col(v).alias(k) for k, v in n.items()])
    if terrain is not None:
        p = readers.join_terrain(p, terrain).withColumn("regime", filters.deformation_regime(F.col("h"), F.col("terrain"), threshold))
    p = filters.reindex(p, "pnt_name", "pnt")
    o = filters.reindex(obs, "date", "epoch").join(p.select("pnt_name", "pnt"), "pnt_name")
    sens = p.select("pnt", F.explode(F.create_map(*sum(([F.lit(k), geo.los_sensitivity(F.col("inc"), F.lit(heading))[k]] for k in ("north", "east", "up")), []))).alias("part", "coef"))
    attrs = F.create_map(F.lit("regime"), F.col("regime").cast("string")) if terrain is not None else F.lit(None).cast("map<string,string>")
    eps = o.select("epoch", tm.dyear(F.col("date").cast("timestamp_ntz")).alias("dyear")).distinct().select(F.lit(dataset_id).alias("dataset_id"), "epoch", F.format_string("%.2f", "dyear").alias("epoch_id"), "dyear", F.lit(None).cast("map<string,string>").alias("attrs"))
    return st.create(spark, dataset_id, "insar", mode="Asc" if (heading - 90) % 360 > 180 else "Dsc", points=_points(p.withColumn("attrs", attrs), dataset_id), epochs=eps,
                     obs=o.select(F.lit(dataset_id).alias("dataset_id"), "pnt", "epoch", F.lit("los").alias("obs_type"), "v"), sens=sens.select(F.lit(dataset_id).alias("dataset_id"), "pnt", F.lit("los").alias("obs_type"), "part", "coef"))


# --- selection and reduction -------------------------------------------------


@dataclass
class SelectOptions:
    point_tolerance: float = 0.5  # km
    epoch_tolerance: float = 0.1  # years
    densify_epochs: float | None = 1.0
    points_per_km2: float | None = None
    cluster_cutoff: float = 250.0  # m


def select(points: DataFrame, epochs: DataFrame, options=None) -> dict[str, DataFrame]:
    """Evaluation points and epochs of datasets: points (dataset_id, pnt, lat, lon, n, e), epochs (dataset_id, epoch, dyear).

    Times closer than the tolerance form one evaluation epoch, points closer than theirs one evaluation point (components of
    near pairs); long gaps and empty cells are filled on demand. Returns eval_points, eval_epochs, xref_points, xref_epochs, clusters.
    """
    opt = merge(SelectOptions(), options)
    pts = points.select("dataset_id", "pnt", "lat", "lon", "n", "e").withColumn("key", F.xxhash64("dataset_id", "pnt"))
    groups = spatial.distance_clusters(pts, opt.point_tolerance * 1000, "key", "n", "e")
    member = pts.join(groups, "key")
    centre = member.groupBy("cluster").agg(*[F.avg(c).alias(c) for c in ("lat", "lon", "n", "e")], F.count_distinct("dataset_id").alias("n_datasets"))
    coded = geo.distinct_codes(centre.withColumn("pnt_id", geo.olc(F.col("lat"), F.col("lon"))), "pnt_id", ["cluster"])
    out_points = coded.select(F.col("cluster").alias("eval_pnt"), "pnt_id", "lat", "lon", "n", "e", "n_datasets", F.lit(False).alias("added"))
    if opt.points_per_km2:
        cells = spatial.empty_cells(out_points, spatial.grid_size(opt.points_per_km2))
        extra = cells.select(F.xxhash64("cx", "cy").alias("eval_pnt"), F.concat_ws("_", F.lit("G"), "cx", "cy").alias("pnt_id"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), "n", "e", F.lit(0).cast("long").alias("n_datasets"), F.lit(True).alias("added"))
        out_points = out_points.unionByName(extra)
    stamped = epochs.select("dataset_id", "epoch", "dyear", F.lit(1).alias("g"))
    sessions = wn.gap_sessions(stamped, ["g"], "dyear", opt.epoch_tolerance)  # epochs are a short list
    dense = wn.densify(sessions.select("g", F.col("t_mean").alias("dyear")), opt.densify_epochs, "dyear", ["g"]) if opt.densify_epochs else sessions.select("g", F.col("t_mean").alias("dyear"), F.lit(False).alias("added"))
    out_epochs = filters.reindex(dense.select("dyear", "added"), "dyear", "eval_epoch")
    keyed = out_epochs.select("eval_epoch", "dyear", F.lit(1).alias("g"))
    xref_epochs = joins.nearest_in_time(stamped.withColumn("row", F.xxhash64("dataset_id", "epoch")), keyed, "row", "eval_epoch", "dyear", None, ["g"]).select("dataset_id", "epoch", F.col("near_eval_epoch").alias("eval_epoch"), "dt")
    clusters = spatial.distance_clusters(out_points, opt.cluster_cutoff, "eval_pnt", "n", "e")
    return {"eval_points": out_points, "eval_epochs": out_epochs, "xref_points": member.select("dataset_id", "pnt", F.col("cluster").alias("eval_pnt")), "xref_epochs": xref_epochs, "clusters": spatial.cluster_table(out_points, clusters, "eval_pnt", ["n", "e"])}


def reduce_by_index(obs: DataFrame, project: dict[str, DataFrame]) -> DataFrame:
    """Observations (dataset_id, pnt, epoch, ...) under the evaluation points and epochs of the project."""
    return joins.by_index(joins.by_index(obs, project["xref_points"], "pnt", "eval_pnt"), project["xref_epochs"], "epoch", "eval_epoch")


def reduce_by_distance(points: DataFrame, eval_points: DataFrame, tolerance: float) -> DataFrame:
    """points (pnt, n, e) with the nearest evaluation point under the tolerance (metres), a blank id where there is none."""
    j = joins.nearest_in_space(points, eval_points.select("eval_pnt", "pnt_id", "n", "e"), tolerance, "pnt", "eval_pnt", "left", "n", "e")
    named = j.join(eval_points.select(F.col("eval_pnt").alias("near_eval_pnt"), F.col("pnt_id").alias("__id")), "near_eval_pnt", "left")
    return named.withColumn("pnt_id", F.coalesce("__id", F.lit(" "))).drop("__id")


def reduce_gnss(daily: DataFrame, eval_epochs: DataFrame, tolerance: float = 14 / 365) -> DataFrame:
    """For every station and evaluation epoch the nearest day closer than the tolerance: (station, eval_epoch, dyear, n_mm, e_mm, u_mm, dt)."""
    stations = daily.select("station").distinct()
    wanted = stations.crossJoin(F.broadcast(eval_epochs.select("eval_epoch", F.col("dyear").alias("t")))).withColumn("row", F.xxhash64("station", "eval_epoch"))
    have = daily.select("station", F.col("dyear").alias("t"), F.struct("dyear", "n_mm", "e_mm", "u_mm").alias("day"))
    j = joins.nearest_in_time(wanted, have, "row", "day", "t", tolerance, ["station"])
    return j.select("station", "eval_epoch", "near_day.*", "dt")


def reduce_insar(points: DataFrame, obs: DataFrame, eval_points: DataFrame, epochs: list[float], radius: float, models: list[list[str]], stochastic: list[str], eval_epochs: list[float] | None = None) -> tuple[DataFrame, DataFrame]:
    """Series of evaluation points from InSAR points (pnt, n, e, regime, pnt_class) and obs (pnt, epoch, v).

    Points within the radius are averaged by regime; each deep series gets its displacement model. Returns the series
    (eval_pnt, epoch, deep, total, shallow, ...) and the chosen models.
    """
    pairs = joins.within_radius(eval_points.select("eval_pnt", "n", "e"), points, radius, "n", "e")
    near = pairs.select(F.col("l.eval_pnt").alias("eval_pnt"), F.col("r.pnt").alias("pnt"), F.col("r.regime").alias("regime"), F.col("r.pnt_class").alias("pnt_class"))
    reduced = ag.reduce_regimes(obs.join(near, "pnt"), ["eval_pnt", "epoch"])
    chosen = testing.classify_points(reduced.select(F.col("eval_pnt").alias("pnt"), F.col("epoch").cast("int").alias("epoch_idx"), F.col("deep").alias("v")), epochs, models, stochastic, eval_epochs)
    return reduced, chosen


def decompose(daily: DataFrame, events: DataFrame | None = None, keep_harmonics: list[str] = (), common_mode: bool = False, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parameters, station summaries and recombined components of daily series (station, dyear, n_mm, e_mm, u_mm)."""
    opt = dict(options)
    if events is not None:
        opt["events"] = {r.station: list(r.years) for r in events.groupBy("station").agg(F.collect_set("year").alias("years")).toPandas().itertuples()}  # a list of edited events
    long = daily.select("station", "dyear", F.explode(F.array(*[F.struct(F.lit(k).alias("component"), F.col(c).alias("y")) for k, c in (("north", "n_mm"), ("east", "e_mm"), ("up", "u_mm"))])).alias("x"))
    ts = long.select("station", "x.component", "dyear", "x.y", F.lit(1.0).alias("sigma"))
    par, comp = series.parameters(ts, **opt), series.components(ts, **opt)
    if common_mode:
        comp = series.remove_common_mode(comp)
    return par, series.summary(par), series.recombine(comp, list(keep_harmonics))
