"""Differences of two matrices of displacements, and their statistics after two-way centering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subsida.operators.aggregates import MAD, std, two_way_center
from subsida.operators.storage import materialize


def difference(a: DataFrame, b: DataFrame, keys=("pnt", "epoch", "obs_type"), value="v", tolerance: float = 1e-5) -> DataFrame:
    """(keys, v): a less b on the points, epochs and types of both; coordinates must agree where both have them."""
    other = b.select(*keys, *[F.col(c).alias(f"__{c}") for c in ("lat", "lon", "dyear") if c in b.columns], F.col(value).alias("__b"))
    j = a.join(other, list(keys))
    off = [F.abs(F.col(c) - F.col(f"__{c}")) >= tolerance for c in ("lat", "lon", "dyear") if c in a.columns and f"__{c}" in other.columns]
    v = F.col(value) - F.col("__b")
    for o in off:
        v = F.when(o, F.raise_error(F.lit("the matrices are not comparable: coordinates or epochs differ")).cast("double")).otherwise(v)
    return j.select(*keys, v.alias("v"))


def difference_stats(diff: DataFrame, rounds: int = 10, eps: float | None = 1e-3) -> DataFrame:
    """(part, min, median, max, mad, std, n) of residuals, transforms (epoch means) and offsets (point means) after two-way centering.

    mad is 1.4826 times the median size, about zero: residuals and means of a centred matrix have no level of their own.
    """
    c = materialize(two_way_center(diff, rounds=rounds, eps=eps), "centred")
    parts = {"residual": c.select(F.col("v").alias("x")), "transform": c.groupBy("epoch").agg(F.max("col_mean").alias("x")).select("x"), "offset": c.groupBy("pnt").agg(F.max("row_mean").alias("x")).select("x")}
    out = None
    for name, p in parts.items():
        s = p.agg(F.min("x").alias("min"), F.median("x").alias("median"), F.max("x").alias("max"), (F.lit(MAD) * F.median(F.abs("x"))).alias("mad"), std(F.col("x")).alias("std"), F.count("x").alias("n"))
        s = s.select(F.lit(name).alias("part"), "*")
        out = s if out is None else out.unionByName(s)
    return out


def project(obs: DataFrame, displ: DataFrame) -> DataFrame:
    """obs with d: displacements (pnt, epoch, north, east, up) seen along each observation's sensitivity."""
    j = obs.join(displ, ["pnt", "epoch"])
    return j.withColumn("d", sum((F.col(f"s_{p}") * F.coalesce(p, F.lit(0.0)) for p in ("north", "east", "up")), F.lit(0.0)))
