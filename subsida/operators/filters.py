"""Row filters and masks of points, epochs, datasets and observations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subsida.operators.storage import materialize

TRUE = F.lit


def in_box(x: Column, y: Column, box: tuple[float, float, float, float]) -> Column:
    """x0 <= x <= x1 and y0 <= y <= y1, pushed down to the scan."""
    x0, y0, x1, y1 = box
    return x.between(x0, x1) & y.between(y0, y1)


def in_polygon(x: Column, y: Column, rings: list[list[tuple[float, float]]]) -> Column:
    """Point in polygon by crossings, the boundary included; further rings are holes or parts. No ring: everything is in.

    The polygon is part of the expression, with its bounding box in front of it, so the filter stays in the JVM and
    the box is pushed down. Fit for outlines of up to some hundred corners; join larger ones by cell instead.
    """
    if not rings:
        return F.lit(True)
    edges = [(a, b) for r in rings for a, b in zip(r, r[1:] + r[:1]) if a != b]
    xs, ys = [a[0] for a, _ in edges], [a[1] for a, _ in edges]
    table = F.array(*[F.struct(F.lit(float(a[0])).alias("x1"), F.lit(float(a[1])).alias("y1"), F.lit(float(b[0])).alias("x2"), F.lit(float(b[1])).alias("y2")) for a, b in edges])

    def cross(e):
        return (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])

    def on(e):
        return (cross(e) == 0) & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))

    def right(e):  # the edge passes the ray to the right of the point
        return ((e["y1"] > y) != (e["y2"] > y)) & ((cross(e) > 0) == (e["y2"] > e["y1"]))

    odd = F.size(F.filter(table, right)) % 2 == 1
    return in_box(x, y, (min(xs), min(ys), max(xs), max(ys))) & (F.exists(table, on) | odd)


def in_periods(t: Column, periods: list[tuple[float, float]]) -> Column:
    """Union of closed intervals; no interval means all times."""
    return reduce(lambda a, b: a | b, [t.between(lo, hi) for lo, hi in periods]) if periods else F.lit(True)


def select_datasets(df: DataFrame, techniques: list[str] | None = None, pattern: str | None = None) -> DataFrame:
    """Datasets of the listed techniques whose id contains the pattern."""
    out = df if not techniques else df.where(F.col("technique").isin(techniques))
    return out if not pattern else out.where(F.col("dataset_id").contains(pattern))


def has_role(technique: Column, mode: Column, listed: list[str]) -> Column:
    """Whether a dataset's technique or mode is listed."""
    return F.coalesce(technique.isin(listed), F.lit(False)) | F.coalesce(mode.isin(listed), F.lit(False))


def matches_any(name: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [name.contains(p) for p in patterns], F.lit(False))


def select_projects(df: DataFrame, name: str, include: list[str] | None = None, exclude: list[str] | None = None, flags: list[int] | None = None, flag: str | None = None) -> DataFrame:
    """Rows by include and exclude name patterns, and by listed observation flags."""
    out = df
    if include:
        out = out.where(matches_any(F.col(name), include))
    if exclude:
        out = out.where(~matches_any(F.col(name), exclude))
    return out if not flags else out.where(F.col(flag).isin(flags))


def reindex(df: DataFrame, key: str, index: str) -> DataFrame:
    """df with index 0, 1, 2, .. of its distinct keys in order.

    Keys are range-partitioned and numbered within each part; parts get their offsets from their counts, so no task sees all keys.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = materialize(df.select(key).where(F.col(key).isNotNull()).distinct().repartitionByRange(n, key).withColumn("__part", F.spark_partition_id()), "reindex")
    counts = parts.groupBy("__part").count()
    offsets = counts.select("__part", F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__offset"))  # one row a part
    own = F.row_number().over(Window.partitionBy("__part").orderBy(key)) - 1
    numbered = parts.withColumn("__own", own).join(F.broadcast(offsets), "__part").select(key, (F.col("__own") + F.col("__offset")).cast("long").alias(index))
    return df.join(numbered, key)


def cascade_delete(obs: DataFrame, points: DataFrame, epochs: DataFrame, point="pnt", epoch="epoch") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Observations of known points and epochs, and the points and epochs that still have any."""
    kept = obs.join(points.select(point), point, "left_semi").join(epochs.select(epoch), epoch, "left_semi")
    return kept, points.join(kept.select(point), point, "left_semi"), epochs.join(kept.select(epoch), epoch, "left_semi")


def delete_covariances(cov: DataFrame, obs: DataFrame, index="i") -> DataFrame:
    """Covariance triplets (i, j, value) whose row and column are both still observed."""
    return cov.join(obs.select(F.col(index).alias("i")), "i", "left_semi").join(obs.select(F.col(index).alias("j")), "j", "left_semi")


def enough_observations(edges: DataFrame, least: int, frm="from_pnt", to="to_pnt", epoch="epoch") -> DataFrame:
    """Points observed in at least `least` epochs, or ever an origin of observations."""
    ends = edges.select(F.col(frm).alias("pnt"), F.col(epoch).alias("epoch"), F.lit(True).alias("origin")).unionByName(edges.select(F.col(to).alias("pnt"), F.col(epoch).alias("epoch"), F.lit(False).alias("origin")))
    n = ends.groupBy("pnt").agg(F.count_distinct("epoch").alias("n_epochs"), F.bool_or("origin").alias("origin"))
    return n.where((F.col("n_epochs") >= least) | F.col("origin"))


def drop_synthetic(points: DataFrame, name="name", coords=("lat", "lon"), synthetic="SYN_BM") -> DataFrame:
    """Points with coordinates and a name of their own."""
    real = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) for c in coords])
    return points.where(real & (F.coalesce(F.col(name), F.lit("")) != synthetic))


def height_only(obs: DataFrame, north="s_north", east="s_east", up="s_up") -> DataFrame:
    """Observations that are sensitive to heights alone; mixed ones are an error at run time."""
    flat = (F.coalesce(F.col(north), F.lit(0.0)) == 0) & (F.coalesce(F.col(east), F.lit(0.0)) == 0)
    checked = F.when(~flat & (F.col(up) != 0), F.raise_error(F.lit("an observation has both horizontal and vertical sensitivity"))).otherwise(flat & (F.col(up) != 0))
    return obs.where(checked)


def stuck_intervals(df: DataFrame, key: str, order: str, values: list[str], crit: float, least: int = 18) -> DataFrame:
    """(key, island, first, last, n): runs of at least `least` samples after whose first every step of all values is under crit.

    Runs at most `least` samples apart are one interval. Gaps and islands by windows within a key.
    """
    w = Window.partitionBy(key).orderBy(order)
    step = F.sqrt(reduce(lambda a, b: a + b, [F.pow(F.col(v) - F.lag(v).over(w), F.lit(2)) for v in values]))
    s = df.withColumn("__i", F.row_number().over(w)).withColumn("__still", F.coalesce(step < crit, F.lit(False)))
    s = s.withColumn("__turn", (F.col("__still") != F.coalesce(F.lag("__still").over(w), F.lit(False))).cast("int")).withColumn("__run", F.sum("__turn").over(w))
    runs = s.where("__still").groupBy(key, "__run").agg(F.count(F.lit(1)).alias("n"), F.min("__i").alias("a"), F.max("__i").alias("b"), F.min(order).alias("first"), F.max(order).alias("last")).where(F.col("n") >= least)
    v = Window.partitionBy(key).orderBy("a")
    apart = F.coalesce(F.col("a") - F.lag("b").over(v) - 1 > least, F.lit(True)).cast("int")
    return runs.withColumn("__new", apart).withColumn("island", F.sum("__new").over(v)).groupBy(key, "island").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))


def mostly_stuck(df: DataFrame, key: str, day: str, flag: str, fraction: float = 0.95) -> DataFrame:
    """Days of a key of which more than the fraction of samples is flagged."""
    return df.groupBy(key, day).agg(F.avg(F.col(flag).cast("double")).alias("fraction")).where(F.col("fraction") > fraction)


def ordered_times(df: DataFrame, key: str, row: str, ts: str) -> DataFrame:
    """Rows less those that the next row (in reading order) doesn't come after."""
    w = Window.partitionBy(key).orderBy(row)
    return df.withColumn("__next", F.lead(ts).over(w)).where(F.col("__next").isNull() | (F.col("__next") > F.col(ts))).drop("__next")


def complete_days(df: DataFrame, keys: list[str], values: list[str], least: int = 20, count: str = "n") -> DataFrame:
    """Means by keys of at least `least` samples, none of whose components is missing in all of them."""
    aggs = [F.avg(v).alias(v) for v in values]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count), *aggs).where(F.col(count) >= least).where(reduce(lambda a, b: a & b, [F.col(v).isNotNull() for v in values]))


def precise(df: DataFrame, sigmas: list[str], largest: float) -> DataFrame:
    """Rows none of whose standard deviations is over the limit."""
    return df.where(reduce(lambda a, b: a & b, [F.coalesce(F.col(s) <= largest, F.lit(True)) for s in sigmas]))


def refine_masks(obs: DataFrame, min_point: int, min_epoch: int, point="pnt", epoch="epoch") -> DataFrame:
    """Points with enough epochs, then epochs with enough points, then points once more."""
    def pass_over(df, key, other, least):
        return df.join(df.groupBy(key).agg(F.count_distinct(other).alias("__n")).where(F.col("__n") >= least).select(key), key, "left_semi")

    return pass_over(pass_over(pass_over(obs, point, epoch, min_point), epoch, point, min_epoch), point, epoch, min_point)


def integration_mask(caps: DataFrame, roi=None, poi=None, exclude_points=None, exclude_epochs=None, min_datasets_point=1, min_datasets_epoch=1, forced_points=None, redundant_only=False, min_displ_point=1, min_displ_epoch=1, capability: int = 1) -> DataFrame:
    """Rows (pnt, epoch, lat, lon, dyear, n_datasets, sc, rp) of the displacements that an integration estimates.

    In this order: region and period, exclusions, capability, datasets per epoch and per point, forced points (exempt from
    the counts), redundancy, least displacements per point and per epoch.
    """
    out = caps
    if roi is not None:
        out = out.where(in_box(F.col("lat"), F.col("lon"), roi) if isinstance(roi, tuple) else in_polygon(F.col("lat"), F.col("lon"), roi))
    out = out.where(in_periods(F.col("dyear"), poi or []))
    if exclude_points:
        out = out.where(~F.col("pnt").isin(exclude_points))
    if exclude_epochs:
        out = out.where(~F.col("epoch").isin(exclude_epochs))
    forced = F.col("pnt").isin(forced_points) if forced_points else F.lit(False)
    out = out.where(F.col("sc") >= capability).withColumn("__forced", forced)

    def at_least(df, key, measure, least):
        n = df.groupBy(key).agg(measure.alias("__n"))
        return df.join(n, key).where((F.col("__n") >= least) | F.col("__forced")).drop("__n")

    out = at_least(out, "epoch", F.max("n_datasets"), min_datasets_epoch)
    out = at_least(out, "pnt", F.max("n_datasets"), min_datasets_point)
    if redundant_only:
        out = out.where((F.col("rp") > 0) | F.col("__forced"))
    out = at_least(out, "pnt", F.count(F.lit(1)), min_displ_point)
    return at_least(out, "epoch", F.count(F.lit(1)), min_displ_epoch).drop("__forced")


def deformation_regime(height: Column, terrain: Column, threshold: float) -> Column:
    """1 (high) where a point stands at least the threshold over the terrain, else 2 (low); null without terrain."""
    return F.when(terrain.isNull() | F.isnan(terrain), None).when(height - terrain >= threshold, 1).otherwise(2)


def regime_by_priority(priority: list[Column]) -> Column:
    """The first of the listed classifications that is known (a list is applied last to first)."""
    return F.coalesce(*priority)


def rename_stations(df: DataFrame, aliases: DataFrame, station="station") -> DataFrame:
    """Stations under their alias (station, alias), where they have one."""
    a = aliases.select(F.col("station").alias("__s"), F.col("alias").alias("__a"))
    return df.join(a, F.col(station) == F.col("__s"), "left").withColumn(station, F.coalesce("__a", station)).drop("__s", "__a")


def merged_name(names: Column) -> Column:
    """One name of an array of '/'-joined names: every part once, in order of appearance."""
    return F.array_join(F.array_distinct(F.split(F.array_join(names, "/"), "/")), "/")


def reclass_los(azimuths: Column) -> Column:
    """asclos or dsclos of a dataset, by all azimuths of its lines of sight (array): all over 180 degrees are ascending."""
    return F.when(F.forall(azimuths, lambda a: F.pmod(a, F.lit(360.0)) > 180), "asclos").when(F.forall(azimuths, lambda a: F.pmod(a, F.lit(360.0)) < 180), "dsclos").otherwise("los")


def normal_heading(heading: Column) -> Column:
    return F.pmod(heading, F.lit(360.0))


def lookup(value: Column, names: dict[str, str], default: str | None = None) -> Column:
    """A listed spelling's standard name, case-insensitively."""
    out = None
    for k, v in names.items():
        out = F.when(F.lower(value) == k.lower(), v) if out is None else out.when(F.lower(value) == k.lower(), v)
    return out.otherwise(F.lit(default) if default is not None else value)
