"""Sinks: wide CSV exports by observation type, station tables, map layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def export_table(points: DataFrame, obs: DataFrame, epochs: list[tuple[int, float]], unit: str = "mm", map_coordinates: bool = False) -> DataFrame:
    """One row a point: ID, Lon, Lat[, X, Y], a column for each epoch and for each standard deviation.

    Points whose values are all zero or missing are left out. obs is (pnt, epoch, v, var) in mm.
    """
    if unit not in ("mm", "m"):
        raise ValueError(f"unit {unit} is not supported")
    scale, digits = (1.0, 2) if unit == "mm" else (1e-3, 5)
    ids = [e for e, _ in epochs]
    p = obs.groupBy("pnt").pivot("epoch", ids).agg(F.first("v").alias("v"), F.first(F.sqrt("var")).alias("sd"))
    some = obs.groupBy("pnt").agg(F.bool_or(F.coalesce(F.col("v"), F.lit(0.0)) != 0).alias("__some")).where("__some").select("pnt")
    j = points.join(p.join(some, "pnt", "left_semi"), "pnt")
    head = [F.col("pnt_name").alias("ID"), F.round("lon", 8).alias("Lon [deg]"), F.round("lat", 8).alias("Lat [deg]")]
    if map_coordinates:
        head += [F.round("e", 2).alias("X [m]"), F.round("n", 2).alias("Y [m]")]
    name = lambda d: f"{d:.5g}" if d == int(d) else f"{d:.8g}"
    cols = [F.round(F.col(f"{e}_v") * scale, digits).alias(f"{name(d)} [{unit}]") for e, d in epochs] + [F.round(F.col(f"{e}_sd") * scale, digits).alias(f"std {name(d)} [{unit}]") for e, d in epochs]
    return j.select(*head, *cols)


def export_csv(points: DataFrame, obs: DataFrame, epochs: list[tuple[int, float]], path: str, dataset_id: str, types: list[str], space: str = "original", crs: str = "WGS84", **options) -> list[str]:
    """A folder of CSV for each observation type; returns their paths."""
    out = []
    for t in types:
        to = f"{path}/{dataset_id}_{t}_{space}_{crs}.csv"
        export_table(points, obs.where(F.col("obs_type") == t), epochs, **options).write.mode("overwrite").csv(to, header=True)
        out.append(to)
    return out


def station_tables(components: DataFrame, path: str) -> None:
    """A CSV of all components for each station."""
    components.repartition("station").sortWithinPartitions("station", "component", "dyear").write.mode("overwrite").partitionBy("station").csv(path, header=True)


def station_covariances(parameters: DataFrame, path: str) -> None:
    parameters.select("station", "component", "par", "estimate", "qxx").write.mode("overwrite").csv(path, header=True)


def map_layer(points: DataFrame, obs: DataFrame, cell: float) -> DataFrame:
    """(epoch, obs_type, cx, cy, v, n): the gridded means that a map would show."""
    j = obs.join(points.select("pnt", "n", "e"), "pnt")
    return j.groupBy("epoch", "obs_type", F.floor(F.col("e") / cell).alias("cx"), F.floor(F.col("n") / cell).alias("cy")).agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("cnt")).withColumnRenamed("cnt", "n")


def histogram(df: DataFrame, value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """(bin, n) of a value, for plots; values outside go to bins 0 and bins + 1."""
    return df.groupBy(F.width_bucket(F.col(value), F.lit(lo), F.lit(hi), F.lit(bins)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
