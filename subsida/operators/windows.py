"""Time-series windows: robust moving filters, steps, gap filling, sessions, events, S-transformations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subsida.functions.geo import letters

from subsida.operators.aggregates import MAD, std


def _frame(key, a, b, order="i"):
    return Window.partitionBy(key).orderBy(order).rowsBetween(a, b)


def numbered(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """df with i = 1, 2, .. in order within the key, and y."""
    return df.withColumn("i", F.row_number().over(Window.partitionBy(key).orderBy(*order))).withColumn("y", F.col(value))


def robust_moving_median(df: DataFrame, key: str, order: list[str], value: str, window: int, crit: float = 5.0) -> DataFrame:
    """df with i, y, ym (moving median), ymad, votes, outlier, sy (scaled median deviation of the series).

    The window is made odd. Every window that holds a value votes on it, windows that reach over the series' ends
    included; a value is an outlier if more than half a window's votes say so.
    """
    half = window // 2
    s = numbered(df, key, order, value).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    pad = lambda lo, hi: F.transform(F.sequence(lo, hi), lambda i: F.struct(i.alias("i"), F.lit(None).cast("double").alias("y")))
    none = F.array().cast("array<struct<i:int,y:double>>")
    own = F.array(F.struct(F.col("i").cast("int").alias("i"), F.col("y").cast("double").alias("y")))
    before = F.when(F.col("i") == 1, pad(F.lit(1 - half), F.lit(0))).otherwise(none)
    after = F.when(F.col("i") == F.col("__n"), pad((F.col("__n") + 1).cast("int"), (F.col("__n") + half).cast("int"))).otherwise(none)
    s = s.withColumn("__x", F.explode(F.concat(before, own, after))).withColumn("i", F.col("__x.i")).withColumn("y", F.col("__x.y")).drop("__x", "__n")
    around = _frame(key, -half, half)
    m = s.withColumn("ym", F.percentile("y", F.lit(0.5)).over(around)).withColumn("__w", F.collect_list("y").over(around))
    dev = F.array_sort(F.transform("__w", lambda v: F.abs(v - F.col("ym"))))
    k = F.size("__w")
    m = m.withColumn("ymad", F.lit(MAD) * (F.get(dev, ((k - 1) / 2).cast("int")) + F.get(dev, (k / 2).cast("int"))) / 2).withColumn("__m", F.collect_list("ym").over(around))
    m = m.where("y is not null").drop("__w")
    sy = m.groupBy(key).agg((F.lit(MAD) * F.median(F.abs(F.col("y") - F.col("ym")))).alias("sy"))
    f = ((half + 1.253**2) / half) ** 0.5
    out = m.join(sy, key).withColumn("votes", F.size(F.filter("__m", lambda c: F.abs(F.col("y") - c) > F.lit(f * crit) * F.col("sy"))))
    return out.withColumn("outlier", F.col("votes") > half).drop("__m")


def moving_mean(df: DataFrame, key: str, window: int, y="y", outlier="outlier") -> DataFrame:
    """df (with i) with ya, sa: moving mean and standard deviation without outliers."""
    half = window // 2
    v, around = F.when(~F.col(outlier), F.col(y)), _frame(key, -half, half)
    n = F.count(v).over(around)
    return df.withColumn("ya", F.avg(v).over(around)).withColumn("sa", F.when(n == 1, 0.0).otherwise(F.stddev_samp(v).over(around)))


def step_scores(df: DataFrame, key: str, window: int, crit: float, y="y", outlier="outlier") -> DataFrame:
    """df (with i) with step, score, is_step, sed, is_sed: means of the windows after and before each value compared.

    score normalises by both windows' deviations; steps are maxima over two neighbours on either side. sed weighs the deviations
    by their 100th powers, so that the calmer window decides; steps are maxima over one neighbour.
    """
    w = window // 2 * 2 + 1
    v = F.when(~F.col(outlier), F.col(y))
    after, before, order = _frame(key, 0, w - 1), _frame(key, -w, -1), Window.partitionBy(key).orderBy("i")

    def spread(f):
        return F.when(F.count(v).over(f) == 1, 0.0).otherwise(F.stddev_samp(v).over(f))

    d = df.withColumn("__a", spread(after)).withColumn("__b", spread(before)).withColumn("step", F.avg(v).over(after) - F.avg(v).over(before))
    ratio = F.when(F.col("__a") > 0, F.pow(F.col("__b") / F.col("__a"), F.lit(100.0)))
    gp = F.when(F.col("__a") == 0, F.when(F.col("__b") > 0, 0.0)).otherwise(1 / (1 + ratio))
    d = d.withColumn("score", F.try_divide(F.col("step"), F.sqrt(F.col("__a") * F.col("__a") + F.col("__b") * F.col("__b")))).withColumn("__gp", gp)
    d = d.withColumn("sed", F.try_divide(F.col("step"), F.sqrt(F.col("__gp") * F.col("__a") * F.col("__a") + (1 - F.col("__gp")) * F.col("__b") * F.col("__b"))))

    def peak(c, reach):
        a = F.abs(F.col(c))
        ok = a > crit
        for k in range(1, reach + 1):
            ok = ok & (a > F.lag(a, k, 0.0).over(order)) & (a > F.lead(a, k, 0.0).over(order))
        return F.coalesce(ok, F.lit(False))

    return d.withColumn("is_step", peak("score", 2)).withColumn("is_sed", peak("sed", 1)).drop("__a", "__b", "__gp")


def step_corrected(df: DataFrame, key: str, window: int, y="y", outlier="outlier", step="step", is_step="is_sed") -> DataFrame:
    """df with ys: the moving mean of which every window's values beyond a step are moved to the centre's level."""
    half = window // 2
    level = F.sum(F.when(F.col(is_step), F.col(step)).otherwise(0.0)).over(_frame(key, Window.unboundedPreceding, 0))
    flat = F.when(~F.col(outlier), F.col(y) - F.col("__level"))
    return df.withColumn("__level", level).withColumn("ys", F.avg(flat).over(_frame(key, -half, half)) + F.col("__level")).drop("__level")


def component_outliers(df: DataFrame, key: str, order: list[str], components: list[str], window: int = 21, crit: float = 5.0) -> DataFrame:
    """(key, i, outlier, components): values that are outliers in any component."""
    rows = numbered(df, key, order, components[0]).drop("y")
    long = rows.select(key, "i", F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).alias("v")) for c in components])).alias("c")).select(F.concat_ws("|", F.col(key).cast("string"), "c.component").alias("__k"), F.col(key), F.col("i").alias("__i"), "c.component", "c.v")
    flagged = robust_moving_median(long, "__k", ["__i"], "v", window, crit).where("outlier")
    return flagged.groupBy(key, F.col("__i").alias("i")).agg(F.array_sort(F.collect_set("component")).alias("components"))


def debias(df: DataFrame, key: str, order: list[str], value: str, is_break: str, before: int = 31, after: int = 30) -> DataFrame:
    """df with value less the jumps so far; a jump is the mean of the next `after` values less that of the `before` last ones."""
    w = Window.partitionBy(key).orderBy(*order)
    jump = F.avg(value).over(w.rowsBetween(0, after - 1)) - F.avg(value).over(w.rowsBetween(-before, -1))
    d = df.withColumn("__jump", F.when(F.col(is_break), F.coalesce(jump, F.lit(0.0))).otherwise(0.0))
    return d.withColumn(value, F.col(value) - F.sum("__jump").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__jump")


def observed_span(obs: DataFrame, key="pnt", epoch="epoch") -> DataFrame:
    """(key, first, last): first and last observed epoch (or point) of each."""
    return obs.groupBy(key).agg(F.min(epoch).alias("first"), F.max(epoch).alias("last"))


def densify(epochs: DataFrame, dt: float, t="t", by: list[str] | None = None) -> DataFrame:
    """(by, t, added): epochs with every gap over dt halved until none is; that is 2^ceil(log2(gap / dt)) equal parts."""
    w = Window.partitionBy(*(by or [])).orderBy(t)
    e = epochs.select(*(by or []), t).distinct().withColumn("__gap", F.lead(t).over(w) - F.col(t))
    parts = F.when(F.col("__gap") > dt, F.pow(F.lit(2.0), F.ceil(F.log2(F.col("__gap") / dt)))).otherwise(1.0).cast("int")
    steps = F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.struct((F.col(t) + F.coalesce(F.col("__gap"), F.lit(0.0)) * j / parts).alias("t"), (j > 0).alias("added")))
    return e.select(*(by or []), F.explode(steps).alias("__s")).select(*(by or []), F.col("__s.t").alias(t), "__s.added")


def with_range(epochs: DataFrame, lo: float, hi: float, dt: float, t="t") -> DataFrame:
    """epochs and the series' ends, where these are further than dt from all others."""
    e = epochs.select(t)
    near = e.agg(F.min(F.abs(F.col(t) - lo)).alias("a"), F.min(F.abs(F.col(t) - hi)).alias("b"))
    ends = near.select(F.explode(F.array_compact(F.array(F.when(F.col("a").isNull() | (F.col("a") > dt), F.lit(lo)), F.when(F.col("b").isNull() | (F.col("b") > dt), F.lit(hi))))).alias(t))
    return e.unionByName(ends)


def gap_sessions(df: DataFrame, key: list[str], t: str, tolerance) -> DataFrame:
    """(key, session, t_mean, first, last, n): times whose neighbours are at most the tolerance apart."""
    w = Window.partitionBy(*key).orderBy(t)
    new = F.coalesce((F.col(t) - F.lag(t).over(w) > tolerance).cast("int"), F.lit(0))
    s = df.withColumn("__new", new).withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy(*key, "session").agg(F.avg(t).alias("t_mean"), F.min(t).alias("first"), F.max(t).alias("last"), F.count(F.lit(1)).alias("n"))


def trim_events(events: DataFrame, first: float, last: float, key="station") -> DataFrame:
    """Events (station, type, year, name) within the data's span.

    Antenna and receiver events before the start are moved to it; of events of one type and time the last stays; the first
    antenna and receiver events that remain are moved to the start.
    """
    swap = F.col("type").isin("ANT", "REC")
    e = events.withColumn("__y0", F.col("year")).withColumn("year", F.when(swap & (F.col("year") < first), first).otherwise(F.col("year")))
    w = Window.partitionBy(key, "type").orderBy("year", "__y0", "name")
    e = e.withColumn("__next", F.lead("year").over(w)).where(F.col("__next").isNull() | (F.col("__next") != F.col("year"))).where(F.col("year").between(first, last))
    head = F.row_number().over(w) == 1
    return e.withColumn("year", F.when(swap & head, first).otherwise(F.col("year"))).drop("__y0", "__next")


def add_event(events: DataFrame, row: dict) -> DataFrame:
    """Events with one more; order is a matter of reading (orderBy type, year)."""
    return events.unionByName(events.sparkSession.createDataFrame([row], events.schema))


def daily_grid(df: DataFrame, key: str, day: str, values: list[str]) -> DataFrame:
    """Every day between a table's first and last for every key, values null where there was none."""
    span = df.agg(F.min(day).alias("a"), F.max(day).alias("b"))
    grid = df.select(key).distinct().crossJoin(F.broadcast(span)).select(key, F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias(day))
    return grid.join(df.select(key, day, *values), [key, day], "left")


def epoch_differences(obs: DataFrame, value="v", pnt="pnt", epoch="k") -> DataFrame:
    """(k, l, y, n, w): mean difference of epochs k > l over the points of both, weight n / (k - l)^2; k, l are epoch indices."""
    a = obs.select(pnt, F.col(epoch).alias("k"), F.col(value).alias("__a"))
    b = obs.select(pnt, F.col(epoch).alias("l"), F.col(value).alias("__b"))
    pairs = a.join(b, pnt).where("k > l").groupBy("k", "l").agg(F.avg(F.col("__a") - F.col("__b")).alias("y"), F.count(F.lit(1)).alias("n"))
    return pairs.withColumn("w", F.col("n") / F.pow(F.col("k") - F.col("l"), F.lit(2)))


def apply_transform(obs: DataFrame, xref: DataFrame, xoff: DataFrame, value="v", pnt="pnt", epoch="epoch") -> DataFrame:
    """obs with value less its epoch's xref and its point's xoff."""
    return obs.join(xref.select(epoch, F.col("xref").alias("__r")), epoch).join(xoff.select(pnt, F.col("xoff").alias("__o")), pnt).withColumn(value, F.col(value) - F.col("__r") - F.col("__o")).drop("__r", "__o")


def dyear_ids(epochs: DataFrame, ts: str, pattern: str = "yyyyMMdd", prefix: str = "E", by: list[str] | None = None) -> DataFrame:
    """epochs with epoch_id: a formatted time with a prefix; repeated ids get a, b, .. z, aa, .. behind them."""
    raw = F.concat(F.lit(prefix), F.date_format(ts, pattern))
    e = epochs.withColumn("__id", raw)
    n = F.row_number().over(Window.partitionBy(*(by or []), "__id").orderBy(ts)) - 1
    return e.withColumn("__n", n).withColumn("epoch_id", F.concat("__id", letters(F.col("__n")))).drop("__id", "__n")
