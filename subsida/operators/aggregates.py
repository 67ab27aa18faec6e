"""Group statistics, reductions, observation counts and parameter capabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subsida.operators.storage import materialize

MAD = 1.4826


def std(c) -> Column:
    """Sample standard deviation; 0 for a single value, null for none."""
    return F.when(F.count(c) == 1, F.lit(0.0)).otherwise(F.stddev_samp(c))


def group_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, mean, n, range, std) by key."""
    return df.groupBy(key).agg(F.avg(value).alias("mean"), F.count(value).alias("n"), (F.max(value) - F.min(value)).alias("range"), std(F.col(value)).alias("std"))


def matched_means(pairs: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Means of every matched group (key with all its partners' rows), each distinct outcome once."""
    return pairs.groupBy(key).agg(*[F.avg(v).alias(v) for v in values]).select(*values).distinct()


def bin_edges(grid: DataFrame, t="t", by: list[str] | None = None, window: float | None = None) -> DataFrame:
    """grid with (lo, hi]: half-way to the neighbours, the ends half the median step further; or a fixed window."""
    if window is not None:
        return grid.withColumn("lo", F.col(t) - window / 2).withColumn("hi", F.col(t) + window / 2)
    w, whole = Window.partitionBy(*(by or [])).orderBy(t), Window.partitionBy(*(by or []))
    g = grid.withColumn("__step", F.lead(t).over(w) - F.col(t))
    g = g.withColumn("__half", F.percentile("__step", F.lit(0.5)).over(whole) / 2)
    return g.withColumn("lo", F.coalesce((F.col(t) + F.lag(t).over(w)) / 2, F.col(t) - F.col("__half"))).withColumn("hi", F.coalesce((F.col(t) + F.lead(t).over(w)) / 2, F.col(t) + F.col("__half"))).drop("__step", "__half")


def mean_bins(obs: DataFrame, width: float, value: str, by: list[str], t="t") -> DataFrame:
    """(by, bin, mean, std, n) over (lo, hi] bins of one width: bin b holds (b - 1, b] widths. n counts missing values, mean and std skip them."""
    b = obs.withColumn("bin", F.ceil(F.col(t) / width))
    return b.groupBy(*by, "bin").agg(F.avg(value).alias("mean"), std(F.col(value)).alias("std"), F.count(F.lit(1)).alias("n"))


def median_bins(obs: DataFrame, width: float, value: str, by: list[str], t="t") -> DataFrame:
    """(by, bin, median, mad, n): medians and scaled median deviations over (lo, hi] bins."""
    b = obs.withColumn("bin", F.ceil(F.col(t) / width))
    med = b.groupBy(*by, "bin").agg(F.median(value).alias("median"), F.count(F.lit(1)).alias("n"))
    dev = b.join(med, [*by, "bin"]).groupBy(*by, "bin").agg((F.lit(MAD) * F.median(F.abs(F.col(value) - F.col("median")))).alias("mad"))
    return med.join(dev, [*by, "bin"])


def strict_mean(c) -> Column:
    """The mean if no value of the group is missing."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.count(c) == F.count(F.lit(1)), F.avg(c))


def reduce_regimes(obs: DataFrame, key: list[str], value="v", regime="regime", cls="pnt_class") -> DataFrame:
    """(key, deep, total, shallow, n_deep, n_total): plain means by regime, of keys that have a deep part.

    Regime 1 (high, founded deep) gives deep, regime 2 total, and shallow is total less deep; a mean with a missing value is
    missing. Where no point of the table has a regime, all are deep. A single reflector of class 5 stands for deep, alone;
    more than one is an error.
    """
    classified = obs.agg(F.coalesce(F.max(F.col(regime) > 0), F.lit(False)).alias("__any"))  # one row
    c5 = F.col(cls) == 5
    deep, total = (F.col(regime) == 1) | ~F.col("__any"), (F.col(regime) == 2) & F.col("__any")
    g = obs.crossJoin(F.broadcast(classified)).groupBy(*key).agg(
        F.count(F.when(c5, 1)).alias("__n5"), F.max(F.when(c5, F.col(value))).alias("__v5"),
        *[f for name, part in (("deep", deep), ("total", total)) for f in (
            F.when(F.count(F.when(part, F.col(value))) == F.count(F.when(part, 1)), F.avg(F.when(part, F.col(value)))).alias(f"__{name}"),
            F.count(F.when(part, 1)).alias(f"__n_{name}"))])
    alone = F.when(F.col("__n5") > 1, F.raise_error(F.lit("more than one reflector of class 5")).cast("boolean")).otherwise(F.col("__n5") == 1)
    g = g.withColumn("__alone", alone)
    out = g.select(
        *key,
        F.when(F.col("__alone"), F.col("__v5")).otherwise(F.col("__deep")).alias("deep"),
        F.when(~F.col("__alone"), F.col("__total")).alias("total"),
        F.when(F.col("__alone"), F.lit(1)).otherwise(F.col("__n_deep")).cast("long").alias("n_deep"),
        F.when(F.col("__alone"), F.lit(0)).otherwise(F.col("__n_total")).cast("long").alias("n_total"),
    ).where("n_deep > 0")
    return out.withColumn("shallow", F.col("total") - F.col("deep"))


def nearest_epochs(obs: DataFrame, key: list[str], dt: str, most: int, largest: float, value="v") -> DataFrame:
    """(key, v, n, dt_mean): the mean of the at most `most` observations nearest in time, under `largest` away."""
    w = Window.partitionBy(*key).orderBy(F.abs(F.col(dt)), dt)
    near = obs.where(F.abs(F.col(dt)) < largest).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most)
    return near.groupBy(*key).agg(F.avg(value).alias(value), F.count(value).alias("n"), F.avg(F.abs(F.col(dt))).alias("dt_mean"))


def mean_pair_distance(df: DataFrame, key: list[str], x: str) -> DataFrame:
    """(key, spread): the mean distance of all pairs on a line, from ranks: sum over pairs of |a - b| without making them."""
    w = Window.partitionBy(*key).orderBy(x)
    r = df.withColumn("__r", F.row_number().over(w))
    n = F.count(F.lit(1))
    return r.groupBy(*key).agg(F.when(n > 1, F.sum((2 * F.col("__r") - 1) * F.col(x)) - n * F.sum(x)).alias("__s"), n.alias("n")).withColumn("spread", F.when(F.col("n") > 1, F.col("__s") / (F.col("n") * (F.col("n") - 1) / 2))).drop("__s")


def mode(c) -> Column:
    """The most frequent value, the smallest of them on ties."""
    return F.mode(c, True)


def observation_counts(obs: DataFrame, types: list[str], keys=("pnt", "epoch"), kind="obs_type") -> DataFrame:
    """(pnt, epoch, a column for each type): datasets that observe it."""
    return obs.groupBy(*keys).pivot(kind, types).agg(F.count_distinct("dataset_id")).fillna(0, types)


PARAMETERS = ("north", "east", "up", "near_east", "near_up", "los_asc", "los_dsc")


def capabilities(counts: DataFrame) -> DataFrame:
    """Contributions to parameters and capability codes, from counts (north, east, up, asc, dsc) of a point and epoch.

    Each step reads what the one before left: both lines of sight make near-east and near-up; lines of sight
    beside East and Up are divided 1/3 to 2/3, or fill the missing one; with North near components become proper
    ones. Adds sp_<parameter>, sc_north, sc_east, sc_up (0 none, 1 under-determined, 2 asc, 3 dsc, 4 near, 7 full).
    """
    sp = {"north": "north", "east": "east", "up": "up", "near_east": F.lit(0.0), "near_up": F.lit(0.0), "los_asc": "asc", "los_dsc": "dsc"}
    d = counts.withColumns({f"sp_{k}": (F.col(v) if isinstance(v, str) else v).cast("double") for k, v in sp.items()})
    c = lambda k: F.col(f"sp_{k}")

    def step(d, cond, change):
        return d.withColumns({f"sp_{k}": F.when(cond, v).otherwise(c(k)) for k, v in change.items()})

    los, no_los = lambda: c("los_asc") + c("los_dsc"), {"los_asc": F.lit(0.0), "los_dsc": F.lit(0.0)}
    low = F.least(c("los_asc"), c("los_dsc"))
    d = step(d, (c("los_asc") > 0) & (c("los_dsc") > 0), {"near_east": low, "near_up": los() - low} | no_los)
    d = step(d, (c("east") > 0) & (c("up") > 0), {"near_east": c("near_east") + los() / 3, "near_up": c("near_up") + los() * 2 / 3} | no_los)
    d = step(d, (c("east") > 0) & (c("up") == 0), {"near_up": c("near_up") + los()} | no_los)
    d = step(d, (c("east") == 0) & (c("up") > 0), {"near_east": c("near_east") + los()} | no_los)
    d = step(d, c("north") > 0, {"east": c("east") + c("near_east"), "up": c("up") + c("near_up"), "near_east": F.lit(0.0), "near_up": F.lit(0.0)})
    d = step(d, (c("north") > 0) & (c("east") > 0), {"east": c("east") + los() / 3, "up": c("up") + los() * 2 / 3} | no_los)
    d = step(d, c("up") > 0, {"up": c("up") + c("near_up"), "near_up": F.lit(0.0)})
    d = step(d, c("east") > 0, {"east": c("east") + c("near_east"), "near_east": F.lit(0.0)})
    has = lambda k: (c(k) > 0).cast("int")
    any_of = lambda *ks: F.greatest(*map(has, ks))
    return d.withColumns({
        "sc_up": 2 * has("los_asc") + 3 * has("los_dsc") + 4 * has("near_up") + 7 * has("up"),
        "sc_east": any_of("los_asc", "los_dsc") + 4 * has("near_east") + 7 * has("east"),
        "sc_north": any_of("los_asc", "los_dsc", "near_east", "near_up") + 7 * has("north"),
    })


def capability_labels(caps: DataFrame, key="pnt") -> DataFrame:
    """(key, capability, dim): which capabilities a point has in any epoch, like under/nearEast,fullUp; dim counts its estimable components.

    A component that is never observed has none; the order of labels is under, asc, dsc, near, full.
    """
    names = {1: "under", 2: "asc", 3: "dsc", 4: "near", 7: "full"}
    parts = {"north": "North", "east": "East", "up": "Up"}
    g = caps.groupBy(key).agg(*[F.bool_or(F.col(f"sc_{p}") == code).alias(f"{p}_{code}") for p in parts for code in names])
    label = lambda p: F.concat(F.coalesce(F.nullif(F.concat_ws("/", *[F.when(F.col(f"{p}_{code}"), n) for code, n in names.items()]), F.lit("")), F.lit("no")), F.lit(parts[p]))
    able = lambda p: F.greatest(*[F.col(f"{p}_{code}").cast("int") for code in names if code > 1])
    return g.select(key, F.concat_ws(",", *map(label, parts)).alias("capability"), sum((able(p) for p in parts), F.lit(0)).alias("dim"))


def redundancy(counts: DataFrame, value: str, by: str) -> DataFrame:
    """(by, n, rp, most): contributions, their excess over one, and the largest excess."""
    r = F.greatest(F.col(value) - 1, F.lit(0))
    return counts.groupBy(by).agg(F.sum(value).alias("n"), F.sum(r).alias("rp"), F.max(r).alias("most"))


def dataset_histogram(obs: DataFrame, key: str) -> DataFrame:
    """(n_datasets, n): how many points (or epochs) have so many datasets."""
    return obs.groupBy(key).agg(F.count_distinct("dataset_id").alias("n_datasets")).groupBy("n_datasets").agg(F.count(F.lit(1)).alias("n"))


def totals(obs: DataFrame, n_parameters: Column, datasets="dataset_id") -> DataFrame:
    """One row: observations, points, epochs, datasets, unknowns of offsets and transforms, rank defect, redundancy."""
    per = obs.groupBy(datasets).agg(F.count(F.lit(1)).alias("m"), F.count_distinct("pnt").alias("np"), F.count_distinct("epoch").alias("ne"))
    g = per.agg(F.sum("m").alias("m"), F.count(F.lit(1)).alias("n_datasets"), F.sum(F.col("np") + F.col("ne")).alias("n_nuisance"), F.count(F.lit(1)).alias("rank_defect"))
    return g.withColumn("n_parameters", n_parameters).withColumn("redundancy", F.col("m") - F.col("n_nuisance") - F.col("n_parameters") + F.col("rank_defect"))


def residual_stack(df: DataFrame, unit: Column, value: str) -> DataFrame:
    """(unit, mean, std, n) of residuals by hour, day or hour of month."""
    return df.groupBy(unit.alias("unit")).agg(F.avg(value).alias("mean"), std(F.col(value)).alias("std"), F.count(value).alias("n"))


def common_mode(params: DataFrame, by: list[str], value="x", variance="qxx") -> DataFrame:
    """(by, x, qxx, n): inverse-variance weighted means over stations (diagonal weights)."""
    w = 1 / F.col(variance)
    return params.where(F.col(variance) > 0).groupBy(*by).agg((F.sum(F.col(value) * w) / F.sum(w)).alias("x"), (1 / F.sum(w)).alias("qxx"), F.count(F.lit(1)).alias("n"))


def two_way_center(df: DataFrame, value="v", rows="pnt", cols="epoch", rounds: int = 10, eps: float | None = 1e-3) -> DataFrame:
    """df with value, row_mean and col_mean after repeated removal of row means and column means (over what is not null).

    Only the two vectors of means are carried from round to round, each written as a narrow table, so a round's plan has a
    fixed size and a row or column of any length is summed in parallel. With eps, rounds end once the squares of a
    round's means sum up to eps at most; without, there are exactly `rounds`.
    """
    base = materialize(df, "centering")
    cells = base.select(F.col(rows).alias("r"), F.col(cols).alias("c"), F.col(value).alias("v"))
    a = cells.select("r").distinct().withColumn("a", F.lit(0.0))
    b = cells.select("c").distinct().withColumn("b", F.lit(0.0))

    def step(key, own, other, of, mean):
        """The vector of `key` with the means of what both vectors leave added, and the sum of their squares."""
        left = F.col("v") - F.col(mean) - F.col(other)
        means = cells.join(b if key == "r" else a, of).join(own, key).groupBy(key).agg(F.first(mean).alias(mean), F.avg(left).alias("m"))
        out = materialize(means.select(key, (F.col(mean) + F.coalesce("m", F.lit(0.0))).alias(mean), F.coalesce("m", F.lit(0.0)).alias("m")), "means")
        return out.drop("m"), out.agg(F.sum(F.col("m") * F.col("m"))).first()[0] or 0.0

    for _ in range(rounds):
        a, e1 = step("r", a, "b", "c", "a")
        b, e2 = step("c", b, "a", "r", "b")
        if eps is not None and e1 + e2 <= eps:
            break
    out = base.join(a.select(F.col("r").alias(rows), F.col("a").alias("row_mean")), rows).join(b.select(F.col("c").alias(cols), F.col("b").alias("col_mean")), cols)
    return out.withColumn(value, F.col(value) - F.col("row_mean") - F.col("col_mean"))


def interval_stats(df: DataFrame, t: str, by: list[str] | None = None) -> DataFrame:
    """min, mean, median, max, mad, std of the gaps between neighbouring times."""
    w = Window.partitionBy(*(by or [])).orderBy(t)
    gaps = df.withColumn("gap", F.lead(t).over(w) - F.col(t)).where("gap is not null")
    med = gaps.groupBy(*(by or [])).agg(F.min("gap").alias("min"), F.avg("gap").alias("mean"), F.median("gap").alias("median"), F.max("gap").alias("max"), std(F.col("gap")).alias("std"))
    joined = gaps.join(med, by) if by else gaps.crossJoin(F.broadcast(med))  # without keys: one row
    return joined.groupBy(*(by or [])).agg(*[F.first(c).alias(c) for c in ("min", "mean", "median", "max", "std")], (F.lit(MAD) * F.median(F.abs(F.col("gap") - F.col("median")))).alias("mad"))


def primary_points(df: DataFrame, cluster: str, n_epochs: str, span: str, pnt: str) -> DataFrame:
    """Of each cluster the point with most epochs, then the longest span, then the first."""
    w = Window.partitionBy(cluster).orderBy(F.desc(n_epochs), F.desc(span), pnt)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def model_tests(res: DataFrame, by: list[str], e2="e2", r="r") -> DataFrame:
    """(by, omt, dof, n): sqrt(sum of normalised squared residuals / sum of redundancy numbers); 0 without redundancy."""
    return res.groupBy(*by).agg(F.when(F.sum(r) > 0, F.sqrt(F.sum(e2) / F.sum(r))).otherwise(0.0).alias("omt"), F.sum(r).alias("dof"), F.count(F.lit(1)).alias("n"))


def approximate_redundancy(res: DataFrame, pnt="pnt", epoch="epoch") -> DataFrame:
    """res with r = 1 - 1/n_epoch - 1/n_point + 1/n, scaled to the redundancy of offsets and transforms."""
    one = F.count(F.lit(1))
    a = res.groupBy(pnt).agg(one.alias("__np"))
    b = res.groupBy(epoch).agg(one.alias("__ne"))
    n = res.agg(one.alias("__n"), F.count_distinct(pnt).alias("__p"), F.count_distinct(epoch).alias("__e"))
    out = res.join(a, pnt).join(b, epoch).crossJoin(F.broadcast(n)).withColumn("__r", 1 - 1 / F.col("__np") - 1 / F.col("__ne") + 1 / F.col("__n"))
    whole = out.agg(F.sum("__r").alias("__s"))
    scale = (F.col("__n") - F.col("__p") - F.col("__e") + 1) / F.col("__s")
    return out.crossJoin(F.broadcast(whole)).withColumn("r", F.when(F.col("__s") > 0, F.col("__r") * scale).otherwise(0.0)).drop("__np", "__ne", "__n", "__p", "__e", "__r", "__s")


def top_rejections(res: DataFrame, test: str, threshold: float, most: int, tie: list[str]) -> DataFrame:
    """The `most` largest test statistics over the threshold, by size."""
    return res.where(F.abs(F.col(test)) > threshold).orderBy(F.desc(F.abs(F.col(test))), *tie).limit(most)


def empirical_sigma(df: DataFrame, key: str, order: str, value: str, formal: str | None = None) -> DataFrame:
    """(key, emp, formal, factor): std of neighbouring differences over sqrt 2, mean formal sigma and their ratio."""
    w = Window.partitionBy(key).orderBy(order)
    d = df.withColumn("__d", F.col(value) - F.lag(value).over(w))
    out = d.groupBy(key).agg((std(F.col("__d")) / F.sqrt(F.lit(2.0))).alias("emp"), *([F.avg(formal).alias("formal")] if formal else []))
    return out.withColumn("factor", F.try_divide("emp", "formal")) if formal else out


def split_networks(edges: DataFrame, epoch="epoch", frm="from_pnt", to="to_pnt", drop: bool = False) -> DataFrame:
    """(epoch, n_origins, n_double): epochs with more than one origin, or points observed more than once; with drop, the edges of the others."""
    origins = edges.groupBy(epoch).agg(F.count_distinct(frm).alias("n_origins"))
    double = edges.groupBy(epoch, to).agg(F.count(F.lit(1)).alias("n")).where("n > 1").groupBy(epoch).agg(F.count(F.lit(1)).alias("n_double"))
    bad = origins.join(double, epoch, "left").withColumn("n_double", F.coalesce("n_double", F.lit(0).cast("long"))).where("n_origins > 1 or n_double > 0")
    return edges.join(bad.select(epoch), epoch, "left_anti") if drop else bad


def count_table(obs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_epochs, first, last, n) of observations by point, for tables and histograms."""
    return obs.groupBy(*keys).agg(F.count_distinct("epoch").alias("n_epochs"), F.min("epoch").alias("first"), F.max("epoch").alias("last"), F.count(F.lit(1)).alias("n"))


def head_and_tail(df: DataFrame, order: str, tie: str, most: int) -> DataFrame:
    """The half-`most` rows at either end, by descending order column; all rows where there are no more than `most`."""
    if df.limit(most + 1).count() <= most:
        return df
    half = most // 2
    return df.orderBy(F.desc(order), tie).limit(most - half).unionByName(df.orderBy(order, F.desc(tie)).limit(half))
