"""Tolerance joins in space and time: nearest neighbour, as-of, radius, bins, interpolation by distance.

Space is cut into square cells of the tolerance's size and time into slots; one side is repeated into neighbouring
cells and the rest is an equi-join, so that no pair outside the neighbourhood is ever made. Rows that share their
coordinates are joined as one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subsida.operators.storage import materialize, shuffle_partitions


#: Rows of one place that are handled as a unit, and pairs of a cell and its neighbours that one key of the join makes.
UNIT, SHARE = 512, 16_000_000


def _places(df: DataFrame, x: str, y: str, *aggs: Column) -> DataFrame:
    """(__x, __y, aggs): one row for each place; rows without a place are left out."""
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("__x"), F.col(y).alias("__y")).agg(*aggs)


def _units(df: DataFrame, x: str, y: str, kept: list[str] | None) -> DataFrame:
    """(__x, __y, members, rows): the rows of each place in arrays of structs, of about UNIT at most."""
    crowded = materialize(_places(df, x, y, F.count(F.lit(1)).alias("__n")).where(F.col("__n") > UNIT), "crowded")
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("__x"), F.col(y).alias("__y"), F.struct(*(kept or ["*"])).alias("__m"))
    block = F.coalesce(F.pmod(F.xxhash64("__m"), F.ceil(F.col("__n") / UNIT)), F.lit(0))
    return rows.join(crowded, ["__x", "__y"], "left").groupBy("__x", "__y", block.alias("__block")).agg(F.collect_list("__m").alias("members"), F.count(F.lit(1)).alias("rows")).drop("__block")


def _meet(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """(l struct, r struct, d): pairs of places or units (__x, __y, rows, ..) under `radius` apart, strictly.

    Cells are cut into shares by the pairs of rows that they and their neighbours hold: a share has some of the left places
    and all of the right ones, so that no task gets a crowded cell as a whole. Partitions are as many as the session has.
    """
    cx, cy = F.floor(F.col("__x") / radius), F.floor(F.col("__y") / radius)
    steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    a = left.select(cx.alias("cx"), cy.alias("cy"), F.struct("*").alias("l"))
    b = right.select(F.struct("*").alias("r"), F.explode(F.array(*[F.struct((cx + i).alias("cx"), (cy + j).alias("cy")) for i, j in steps])).alias("c")).select("c.cx", "c.cy", "r")
    pairs = F.col("na").cast("double") * F.col("nb")
    load = a.groupBy("cx", "cy").agg(F.sum("l.rows").alias("na")).join(b.groupBy("cx", "cy").agg(F.sum("r.rows").alias("nb")), ["cx", "cy"])
    shares = materialize(load.where(pairs > SHARE).select("cx", "cy", F.ceil(pairs / SHARE).cast("int").alias("shares")), "shares")
    a = a.join(shares, ["cx", "cy"], "left").withColumn("share", F.coalesce(F.pmod(F.xxhash64("l"), F.col("shares")), F.lit(0)).cast("int")).drop("shares")
    b = b.join(shares, ["cx", "cy"], "left").withColumn("share", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1))).drop("shares")
    n, key = shuffle_partitions(left.sparkSession), ["cx", "cy", "share"]
    dx, dy = F.col("l.__x") - F.col("r.__x"), F.col("l.__y") - F.col("r.__y")
    met = a.repartition(n, *key).join(b.repartition(n, *key), key)
    return met.select("l", "r", F.sqrt(dx * dx + dy * dy).alias("d")).where(F.col("d") < radius)


def _nearest_places(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """(__x, __y, d, __r): for each place of left the nearest of right (__x, __y, __r, rows); equal distances go to the smaller __r."""
    return _meet(left, right, radius).groupBy("l.__x", "l.__y").agg(F.min(F.struct("d", "r.__r")).alias("__b")).select("__x", "__y", "__b.d", "__b.__r")


def nearest_in_space(left: DataFrame, right: DataFrame, tolerance: float, left_id: str, right_id: str, how: str = "inner", x="x", y="y") -> DataFrame:
    """left with the nearest row of right that is closer than the tolerance: (left.*, right_id, d); equal distances go to the smaller right_id.

    Places meet, not rows: those that share their coordinates have the same nearest row.
    """
    one = F.lit(1).alias("rows")
    sources = materialize(_places(right, x, y, F.min(right_id).alias("__r"), one), "places")
    best = _nearest_places(materialize(_places(left, x, y, one), "places"), sources, tolerance)
    best = best.select(F.col("__x").alias("__lx"), F.col("__y").alias("__ly"), F.col("__r").alias(f"near_{right_id}"), F.col("d").alias("__d"))
    return left.join(best, (F.col(x) == F.col("__lx")) & (F.col(y) == F.col("__ly")), how).withColumn("d", F.col("__d")).drop("__lx", "__ly", "__d")


def one_to_one(pairs: DataFrame, target: str, source: str) -> DataFrame:
    """Of the sources that share a target, the last one counts."""
    return pairs.withColumn("__n", F.row_number().over(Window.partitionBy(target).orderBy(F.desc(source)))).where("__n = 1").drop("__n")


def within_radius(left: DataFrame, right: DataFrame, radius: float, x="x", y="y", kept: list[str] | None = None, of_d: dict[str, Column] | None = None) -> DataFrame:
    """All pairs (l, r, d) strictly under the radius apart; l and r hold the columns `kept` of both, or all.

    Rows come in units that share a place. A distance, and what of_d makes of the column d, is found once for each pair of units;
    what the pairs are many of is only written out, in tasks of bounded size.
    """
    own = materialize(_units(left, x, y, kept), "units")
    other = own if left is right else materialize(_units(right, x, y, kept), "units")
    met = _meet(own, other, radius).select(F.col("l.members").alias("l"), F.col("r.members").alias("r"), "d", *[c.alias(k) for k, c in (of_d or {}).items()])
    rest = ["d", *(of_d or {})]
    return met.select(F.explode("l").alias("l"), "r", *rest).select("l", F.explode("r").alias("r"), *rest)


def summary_within_radius(left: DataFrame, right: DataFrame, radius: float, x="x", y="y") -> DataFrame:
    """left with the number n and the mean distance d of the rows of right strictly under the radius; without those that have none."""
    a = materialize(_places(left, x, y, F.lit(1).alias("rows")), "places")
    b = materialize(_places(right, x, y, F.lit(1).alias("rows"), F.count(F.lit(1)).alias("__n")), "places")
    near = _meet(a, b, radius).groupBy(F.col("l.__x").alias("__lx"), F.col("l.__y").alias("__ly")).agg(F.sum("r.__n").alias("n"), F.sum(F.col("d") * F.col("r.__n")).alias("__s"))
    return left.join(near, (F.col(x) == F.col("__lx")) & (F.col(y) == F.col("__ly"))).withColumn("d", F.col("__s") / F.col("n")).drop("__lx", "__ly", "__s")


def near_places(points: DataFrame, radius: float, key: str, x="x", y="y") -> tuple[DataFrame, DataFrame]:
    """(a, b), pairs of places under the radius apart, each named by its smallest key, a < b; and the places (__x, __y, __r)."""
    p = materialize(_places(points, x, y, F.min(key).alias("__r"), F.lit(1).alias("rows")), "places")
    return _meet(p, p, radius).select(F.col("l.__r").alias("a"), F.col("r.__r").alias("b")).where("a < b"), p


def nearest_in_time(left: DataFrame, right: DataFrame, left_id: str, right_id: str, t="t", tolerance: float | None = None, by: list[str] | None = None, how: str = "inner") -> DataFrame:
    """left with the nearest row of right in time, within equal `by` keys: (left.*, near_<right_id>, dt).

    With a tolerance (strict) times are cut into slots of its length; without one, both sides are merged in time order
    within their keys and each left row sees the last right row before and the first after it. Equal distances go to the smaller right_id.
    """
    by = by or []
    if tolerance is not None:
        a = left.select(*by, F.col(left_id).alias("__l"), F.col(t).alias("__lt"), F.floor(F.col(t) / tolerance).alias("__s"))
        b = right.select(*by, F.col(right_id).alias("__r"), F.col(t).alias("__rt"), F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda i: F.floor(F.col(t) / tolerance) + i)).alias("__s"))
        pairs = a.join(b, [*by, "__s"]).withColumn("dt", F.abs(F.col("__lt") - F.col("__rt"))).where(F.col("dt") < tolerance)
    else:
        a = left.select(*by, F.col(left_id).alias("__l"), F.col(t).alias("__lt"), F.lit(None).cast(right.schema[right_id].dataType).alias("__r"), F.lit(1).alias("__side"))
        b = right.select(*by, F.lit(None).cast(left.schema[left_id].dataType).alias("__l"), F.col(t).alias("__lt"), F.col(right_id).alias("__r"), F.lit(0).alias("__side"))
        seen = F.when(F.col("__side") == 0, F.struct(F.col("__lt").alias("t"), F.col("__r").alias("r")))
        up = Window.partitionBy(*by).orderBy("__lt", "__side", F.desc("__r"))
        down = Window.partitionBy(*by).orderBy(F.desc("__lt"), "__side", F.desc("__r"))
        m = a.unionByName(b).withColumn("__p", F.last(seen, ignorenulls=True).over(up)).withColumn("__n", F.last(seen, ignorenulls=True).over(down)).where("__side = 1")
        pairs = m.select(*by, "__l", "__lt", F.explode(F.array_compact(F.array("__p", "__n"))).alias("__c")).select(*by, "__l", F.col("__c.r").alias("__r"), F.abs(F.col("__lt") - F.col("__c.t")).alias("dt"))
    best = pairs.groupBy(*[F.col(k).alias(f"__k_{k}") for k in by], "__l").agg(F.min(F.struct("dt", "__r")).alias("__b"))
    same = [F.col(k) == F.col(f"__k_{k}") for k in by]
    out = left.join(best, [F.col(left_id) == F.col("__l"), *same], how)
    return out.withColumn(f"near_{right_id}", F.col("__b.__r")).withColumn("dt", F.col("__b.dt")).drop("__l", "__b", *[f"__k_{k}" for k in by])


def by_index(obs: DataFrame, xref: DataFrame, index: str, target: str) -> DataFrame:
    """Equi lookup through a dataset's index table (dataset_id, index, target)."""
    return obs.join(xref.select("dataset_id", index, target), ["dataset_id", index])


def harmonise(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows whose harmonised id both tables have."""
    return a.join(b, key)


def on_date(obs: DataFrame, meteo: DataFrame, ts="ts", day="day") -> DataFrame:
    """Observations with the weather of their date."""
    return obs.withColumn(day, F.to_date(ts)).join(meteo, day)


def voronoi_bins(epochs: DataFrame, t="t", by: list[str] | None = None) -> DataFrame:
    """epochs with [lo, hi): the mid-times to their neighbours; open ends reach to infinity."""
    w = Window.partitionBy(*(by or [])).orderBy(t)
    inf = float("inf")
    return epochs.withColumn("lo", F.coalesce((F.col(t) + F.lag(t).over(w)) / 2, F.lit(-inf))).withColumn("hi", F.coalesce((F.col(t) + F.lead(t).over(w)) / 2, F.lit(inf)))


def assign_bins(obs: DataFrame, bins: DataFrame, t="t", bin_id="bin") -> DataFrame:
    """obs with the bin whose [lo, hi) holds its time: bins are merged into the time order and the last begun one is carried on.

    bins must tile the time line, as voronoi_bins() does. The order is cut into ranges; each carries its last bin into
    the ranges after it, so no task sees all times and nothing that grows with the bins is handed out.
    """
    begun = bins.select(F.col("lo").cast("double").alias("__t"), F.lit(0).alias("__side"), F.struct(F.col(bin_id).alias("b")).alias("__bin"), F.lit(None).cast(obs.schema).alias("__row"))
    seen = obs.select(F.col(t).cast("double").alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(begun.schema["__bin"].dataType).alias("__bin"), F.struct("*").alias("__row"))
    ranged = materialize(begun.unionByName(seen).repartitionByRange("__t", "__side").withColumn("__part", F.spark_partition_id()), "times")
    last = ranged.where("__side = 0").groupBy("__part").agg(F.max_by("__bin", "__t").alias("__last"))
    parts = ranged.select("__part").distinct().join(last, "__part", "left")  # a row for each range
    carried = F.last("__last", ignorenulls=True).over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("__part", carried.alias("__carried"))
    own = F.last("__bin", ignorenulls=True).over(Window.partitionBy("__part").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0))
    found = ranged.withColumn("__own", own).where("__side = 1").join(F.broadcast(parts), "__part")
    return found.select("__row.*", F.coalesce("__own", "__carried")["b"].alias(bin_id))


#: Sources that are handed to every task at once.
STATIONS = 20_000


def inverse_distance(targets: DataFrame, sources: DataFrame, target_id: str, value: str, power: float = 2.0, x="x", y="y") -> DataFrame:
    """(target_id, value): sum(w v) / sum(w), w = d^-power over all sources; null where a source is at distance 0.

    Every place of targets meets every place of sources, as the weights ask for; rows that share their coordinates count as
    one place, so that repeated places add nothing to the pairs. Places of sources are handed to the tasks in blocks of
    STATIONS at most, those of targets are dealt evenly, and what a block gives to a target is summed before anything moves.
    """
    s = sources.groupBy(F.col(x).alias("__x"), F.col(y).alias("__y")).agg(F.sum(value).alias("__v"), F.count(F.lit(1)).alias("__n"))
    s = materialize(s, "sources")
    places = targets.select(F.col(x).alias("__tx"), F.col(y).alias("__ty")).distinct()
    places = materialize(places.repartition(shuffle_partitions(targets.sparkSession), "__tx", "__ty"), "targets")
    blocks = max(1, -(-s.count() // STATIONS))
    dx, dy = F.col("__tx") - F.col("__x"), F.col("__ty") - F.col("__y")
    square = dx * dx + dy * dy
    w = F.when(square > 0, 1 / square if power == 2 else F.pow(square, F.lit(-power / 2)))
    sums = None
    for i in range(blocks):
        part = s if blocks == 1 else s.where(F.pmod(F.xxhash64("__x", "__y"), F.lit(blocks)) == i)
        pairs = places.crossJoin(F.broadcast(part)).select("__tx", "__ty", (w * F.col("__n")).alias("w"), (w * F.col("__v")).alias("wv"))
        own = pairs.groupBy("__tx", "__ty").agg(F.sum("w").alias("w"), F.sum("wv").alias("wv"), (F.count(F.lit(1)) - F.count("w")).alias("hit"))
        sums = own if sums is None else sums.unionByName(own)
    found = sums.groupBy("__tx", "__ty").agg(F.when(F.sum("hit") == 0, F.sum("wv") / F.sum("w")).alias("__value"))
    own = targets.select(target_id, F.col(x).alias("__tx"), F.col(y).alias("__ty"))
    return own.join(found, ["__tx", "__ty"], "left").select(target_id, F.col("__value").alias(value))


def complete_stations(meteo: DataFrame, epochs: DataFrame, station="station", epoch="epoch") -> DataFrame:
    """Stations that have every epoch."""
    n = epochs.select(epoch).distinct().agg(F.count(F.lit(1)).alias("__all"))
    have = meteo.join(epochs.select(epoch).distinct(), epoch, "left_semi").groupBy(station).agg(F.count_distinct(epoch).alias("__n"))
    return meteo.join(have.crossJoin(F.broadcast(n)).where("__n = __all").select(station), station, "left_semi")


def merge_histograms(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, n_a, n_b): two histograms side by side, 0 where one has no such key."""
    j = a.withColumnRenamed("n", "n_a").join(b.withColumnRenamed("n", "n_b"), key, "full")
    return j.select(key, F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))


def stack_correction(obs: DataFrame, stack: DataFrame, hour="hour", value="v", least: int = 1) -> DataFrame:
    """Observations less the mean residual of their whole hour; hours without a mean of `least` samples are dropped."""
    s = stack.where(F.col("n") >= least).select(F.col(hour), F.col("mean").alias("__m"))
    return obs.join(s, hour).withColumn(value, F.col(value) - F.col("__m")).drop("__m")


def pair_distances(points: DataFrame, key: str, x="x", y="y") -> DataFrame:
    """(a, b, d) of all ordered pairs: for the covariance of a stated, small set of points."""
    a = points.select(F.col(key).alias("a"), F.col(x).alias("__x"), F.col(y).alias("__y"))
    b = points.select(F.col(key).alias("b"), F.col(x).alias("__u"), F.col(y).alias("__v"))
    return a.crossJoin(b).select("a", "b", F.hypot(F.col("__x") - F.col("__u"), F.col("__y") - F.col("__v")).alias("d"))
