"""Readers of the import formats, by Spark's own scans: levelling edges, GNSS, InSAR, weather, events, outlines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subsida.functions import time as tm

EDGES = "project string, epoch_days double, from_pnt long, to_pnt long, sd_obs double, sd_flag int, s_north double, s_east double, s_up double"


def levelling_edges(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Height differences between points; epochs in days since 1970 become decimal years."""
    df = spark.read.schema(EDGES).format(fmt).options(**({"header": "true"} if fmt == "csv" else {})).load(path)
    return df.withColumn("dyear", tm.mjd_to_dyear(F.col("epoch_days") + float(tm.MJD_1970)))


def gnss_csv(spark: SparkSession, path: str) -> DataFrame:
    """(station, row, ts, lat, lon, h): time, latitude and longitude in degrees, minutes, seconds, height; the station is the file's name."""
    schema = "time string, lat_d double, lat_m double, lat_s double, lon_d double, lon_m double, lon_s double, h double"
    df = spark.read.schema(schema).csv(path, header=True)
    dms = lambda p: F.col(f"{p}_d") + F.col(f"{p}_m") / 60 + F.col(f"{p}_s") / 3600
    ts = F.coalesce(*[F.try_to_timestamp("time", F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "dd-MM-yyyy HH:mm:ss", "yyyy/MM/dd HH:mm:ss")]).cast("timestamp_ntz")
    return df.select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("station"), F.monotonically_increasing_id().alias("row"), ts.alias("ts"), dms("lat").alias("lat"), dms("lon").alias("lon"), "h")


#: Fixed value: the columns before the epochs in the wide InSAR format.
INSAR_FIXED = 19


def insar_csv(spark: SparkSession, path: str, names: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Points (the fixed columns) and obs (pnt_name, date, v) of a wide file with one column for each epoch, like d31122015.

    Epoch columns are unpivoted by an expression over the header; each row is read once.
    """
    head = spark.read.text(path).first()[0].split(",")
    df = spark.read.schema(", ".join(f"`{c}` {'string' if i == 0 else 'double'}" for i, c in enumerate(head))).csv(path, header=True)
    fixed, epochs = head[:INSAR_FIXED], head[INSAR_FIXED:]
    points = df.select(*[F.col(f"`{c}`").alias((names or fixed)[i]) for i, c in enumerate(fixed)])
    date = lambda c: re.sub(r"\D", "", c)
    pairs = F.array(*[F.struct(F.lit(f"{d[4:8]}-{d[2:4]}-{d[:2]}").alias("date"), F.col(f"`{c}`").alias("v")) for c in epochs if (d := date(c))])
    obs = df.select(F.col(f"`{fixed[0]}`").alias("pnt_name"), F.explode(pairs).alias("x")).select("pnt_name", F.to_date("x.date").alias("date"), "x.v").where("v is not null and not isnan(v)")
    return points, obs


def join_terrain(points: DataFrame, terrain: DataFrame, name="pnt_name", height="terrain", missing: float = -327.7) -> DataFrame:
    """points with a terrain height by name; the marker of missing heights is null."""
    t = terrain.select(name, F.when(F.abs(F.col(height) - missing) > 1e-6, F.col(height)).alias(height))
    return points.join(t, name, "left")


def stochastic_parameters(spark: SparkSession, path: str) -> DataFrame:
    """(system, mode, model) from a table of model parameters by system and mode."""
    df = spark.read.csv(path, header=True)
    cols = {c.strip().lower(): c for c in df.columns}
    par = [cols[c] for c in cols if c not in ("system", "mode")]
    text = F.concat(F.lit("tudinsar4("), F.concat_ws(",", *[F.concat(F.lit(f"{c.strip()}="), F.trim(F.col(f"`{c}`"))) for c in par]), F.lit(")"))
    return df.select(F.trim(F.col(f"`{cols['system']}`")).alias("system"), F.trim(F.col(f"`{cols['mode']}`")).alias("mode"), text.alias("model"))


def meteo_hourly(spark: SparkSession, path: str) -> DataFrame:
    """(station, day, hour, t, p) of hourly weather files: comment lines, one naming the columns, tenths of units."""
    lines = spark.read.text(path)
    head = lines.where(F.col("value").startswith("# STN,YYYY")).first()[0]
    names = [c.strip() for c in head[1:].split(",")]
    at = {c: i for i, c in enumerate(names)}
    v = F.split("value", ",")
    get = lambda c: F.trim(F.get(v, F.lit(at[c])))
    rows = lines.where(~F.col("value").startswith("#") & (F.length(F.trim("value")) > 0))
    return rows.select(get("STN").alias("station"), F.to_date(get("YYYYMMDD"), "yyyyMMdd").alias("day"), get("HH").try_cast("int").alias("hour"), (get("T").try_cast("double") * 0.1).alias("t"), (get("P").try_cast("double") * 0.1).alias("p"))


def daily_meteo(hourly: DataFrame) -> DataFrame:
    return hourly.groupBy("station", "day").agg(F.avg("t").alias("t"), F.avg("p").alias("p"))


def meteo_at(hourly: DataFrame, days: int = 7) -> DataFrame:
    """hourly with t_week, the mean temperature of the hours in the days before."""
    from pyspark.sql import Window

    hours = F.unix_timestamp(F.col("day").cast("timestamp")) + F.col("hour") * 3600
    w = Window.partitionBy("station").orderBy("__s").rangeBetween(-days * 86400, 0)
    return hourly.withColumn("__s", hours).withColumn("t_week", F.avg("t").over(w)).drop("__s")


def events_csv(spark: SparkSession, path: str) -> DataFrame:
    """(station, type, year, name, remarks) of an event list."""
    df = spark.read.schema("station string, date string, type string, name string, remarks string").csv(path, header=True)
    ts = F.try_to_timestamp("date", F.lit("yyyy-MM-dd'T'HH:mm'Z'")).cast("timestamp_ntz")
    return df.select("station", "type", tm.dyear(ts).alias("year"), F.trim("name").alias("name"), "remarks")


def outline(text: str | bytes | list, fmt: str | None = None) -> list[list[tuple[float, float]]]:
    """Rings (lists of (x, y)) of a box [[x0, y0], [x1, y1]], numbers with NaN rows between rings, or the text of a .coo, .kml or .shp file."""
    if fmt in ("json", "wkt"):
        raise ValueError(f"{fmt} outlines are not supported")
    if isinstance(text, list):
        rows = [tuple(map(float, r)) for r in text]
        if len(rows) == 2:
            (x0, y0), (x1, y1) = rows
            return [[(x0, y0), (x1, y0), (x1, y1), (x0, y1)]]
        rings: list = [[]]
        for r in rows:
            if r[0] != r[0]:
                rings.append([])
            else:
                rings[-1].append(r)
        return [_open(r) for r in rings if r]
    if fmt == "coo":
        return [_open([tuple(map(float, line.split()[:2])) for line in part.splitlines() if line.strip() and line.strip()[0] not in "#%"]) for part in re.split(r"\n\s*\n", text.strip())]
    if fmt == "kml":
        rings = []
        for place in re.findall(r"<Placemark.*?</Placemark>", text, re.S):
            for c in re.findall(r"<coordinates>(.*?)</coordinates>", place, re.S):
                rings.append(_open([tuple(map(float, p.split(",")[:2])) for p in c.split()]))
        return rings
    if fmt == "shp":
        return _shapefile(text)
    raise ValueError(f"unknown outline format {fmt}")


def _open(ring: list) -> list:
    return ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring


def _shapefile(raw: bytes) -> list[list[tuple[float, float]]]:
    """Rings of the polygons of a shapefile's main file."""
    import struct

    rings, at = [], 100
    while at + 8 <= len(raw):
        size = struct.unpack_from(">i", raw, at + 4)[0] * 2
        body = at + 8
        if struct.unpack_from("<i", raw, body)[0] in (5, 15, 25):
            parts, n = struct.unpack_from("<ii", raw, body + 36)
            starts = [*struct.unpack_from(f"<{parts}i", raw, body + 44), n]
            xy = struct.unpack_from(f"<{2 * n}d", raw, body + 44 + 4 * parts)
            rings += [_open([(xy[2 * i], xy[2 * i + 1]) for i in range(a, b)]) for a, b in zip(starts, starts[1:])]
        at = body + size
    return rings


def read_outline(spark: SparkSession, path: str) -> list[list[tuple[float, float]]]:
    """The rings of an outline file, by its ending."""
    fmt = path.rsplit(".", 1)[-1].lower()
    raw = bytes(spark.read.format("binaryFile").load(path).first()["content"])
    return outline(raw if fmt == "shp" else raw.decode(), fmt)


def read_grid(spark: SparkSession, path: str) -> dict:
    from subsida.functions.rdnap import read_grid as parse

    return parse(bytes(spark.read.format("binaryFile").load(path).first()["content"]))
