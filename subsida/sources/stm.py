"""Space-time matrices as tables: points, epochs, observations in long form, and their metadata.

On disk a matrix is a folder: points/, epochs/, obs/ (partitioned by obs_type, sorted by point and epoch within files),
aux/, sens/, stoch/, lineage/ and meta/, all Parquet. Missing observations are absent rows.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "points": "dataset_id string, pnt long, pnt_name string, pnt_id string, lat double, lon double, h double, n double, e double, attrs map<string,string>",
    "epochs": "dataset_id string, epoch long, epoch_id string, dyear double, attrs map<string,string>",
    "obs": "dataset_id string, pnt long, epoch long, obs_type string, v double",
    "aux": "dataset_id string, pnt long, epoch long, aux_type string, v double",
    "sens": "dataset_id string, pnt long, obs_type string, part string, coef double",
    "stoch": "dataset_id string, obs_type string, layer int, model string",
    "cov": "dataset_id string, obs_type string, i long, j long, value double",
    "lineage": "child_id string, parent_id string, ordinal int, attrs map<string,string>",
}
#: Observation types and parameters of the reserved techniques.
TECHNIQUES = {"lev": (["Up"], ["North", "East", "Up"]), "gnss": (["North", "East", "Up"], ["North", "East", "Up"]), "insar": (["los"], ["North", "East", "Up"]), "displ": (["North", "East", "Up"], ["North", "East", "Up"])}


@dataclass
class Stm:
    """A space-time matrix; tables are lazy."""

    dataset_id: str
    technique: str
    tables: dict[str, DataFrame] = field(default_factory=dict)
    attrs: dict[str, str] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def with_tables(self, **tables: DataFrame) -> Stm:
        return replace(self, tables=self.tables | tables)

    @property
    def obs_types(self) -> list[str]:
        return json.loads(self.attrs["obs_types"])


def create(spark: SparkSession, dataset_id: str, technique: str, mode: str | None = None, project: str | None = None, parents: list[Stm] = (), **tables: DataFrame) -> Stm:
    """A matrix with its technique's defaults, empty tables where none are given, and the lineage of its inputs."""
    if technique not in TECHNIQUES and technique != "projectFile":
        raise ValueError(f"unknown technique {technique}")
    types, parts = TECHNIQUES.get(technique, ([], []))
    full = {k: tables.get(k) if tables.get(k) is not None else spark.createDataFrame([], s) for k, s in SCHEMAS.items()}
    if parents:
        rows = [(dataset_id, p.dataset_id, i, {k: v for k, v in p.attrs.items()}) for i, p in enumerate(parents)]
        own = spark.createDataFrame(rows, SCHEMAS["lineage"])
        for p in parents:
            own = own.unionByName(p["lineage"])
        full["lineage"] = own
    attrs = {"obs_types": json.dumps(types), "par_types": json.dumps(parts), "system": "", "mode": mode or "", "project": project or ""}
    return Stm(dataset_id, technique, full, attrs)


#: What the modes of read() leave out.
MODES = {"DATA": (), "NODATA": ("obs", "aux", "cov"), "NOSTOCHDATA": ("cov",), "OBJECT": (), "OBSDATA": tuple(k for k in SCHEMAS if k != "obs"), "AUXDATA": tuple(k for k in SCHEMAS if k != "aux"), "STOCHDATA": tuple(k for k in SCHEMAS if k not in ("stoch", "cov"))}


def read(spark: SparkSession, path: str, mode: str = "DATA", points: list[int] | None = None, epochs: list[int] | None = None, types: list[str] | None = None) -> Stm:
    """A matrix from its folder; index lists and types are pushed down to the scan. Every mode is lazy."""
    meta = spark.read.json(f"{path}/meta").first()
    skip, tables = MODES[mode.upper()], {}
    for name, schema in SCHEMAS.items():
        df = spark.createDataFrame([], schema) if name in skip else spark.read.schema(schema).parquet(f"{path}/{name}")
        if points is not None and "pnt" in df.columns:
            df = df.where(F.col("pnt").isin(points))
        if epochs is not None and "epoch" in df.columns:
            df = df.where(F.col("epoch").isin(epochs))
        if types is not None and "obs_type" in df.columns:
            df = df.where(F.col("obs_type").isin(types))
        tables[name] = df
    return Stm(meta["dataset_id"], meta["technique"], tables, json.loads(meta["attrs"]))


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def write(stm: Stm, path: str, mode: str = "DATA") -> None:
    """Write all tables (DATA), those without data (NODATA), or those beside the data of an existing folder (APPEND)."""
    spark = stm["points"].sparkSession
    if mode.upper() == "NODATA" and _exists(spark, f"{path}/obs") and not spark.read.schema(SCHEMAS["obs"]).parquet(f"{path}/obs").isEmpty():
        raise ValueError(f"{path} holds data; write with APPEND to keep them")
    skip = {"DATA": (), "NODATA": ("obs", "aux", "cov"), "APPEND": ("obs", "aux", "cov")}[mode.upper()]
    for name in SCHEMAS:
        if name in skip and mode.upper() == "APPEND":
            continue
        df = stm[name].select([c.split()[0] for c in SCHEMAS[name].split(", ")]) if name not in skip else stm[name].limit(0)
        if name == "obs":
            df.repartition("obs_type", F.floor(F.col("pnt") / 100_000)).sortWithinPartitions("obs_type", "pnt", "epoch").write.mode("overwrite").partitionBy("obs_type").parquet(f"{path}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([(stm.dataset_id, stm.technique, json.dumps(stm.attrs))], "dataset_id string, technique string, attrs string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def patch(spark: SparkSession, path: str, rows: DataFrame, keys=("dataset_id", "pnt", "epoch", "obs_type")) -> None:
    """Replace observations in place: the old rows less the patched ones, and the patch, written beside and swapped in."""
    old = spark.read.schema(SCHEMAS["obs"]).parquet(f"{path}/obs")
    new = old.join(rows.select(*keys), list(keys), "left_anti").unionByName(rows.select(old.columns))
    new.sortWithinPartitions("pnt", "epoch").write.mode("overwrite").partitionBy("obs_type").parquet(f"{path}/obs.new")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target, fresh = hadoop.Path(f"{path}/obs"), hadoop.Path(f"{path}/obs.new")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    aside = hadoop.Path(f"{path}/obs.old")
    fs.delete(aside, True)
    fs.rename(target, aside)  # at every moment one whole table is there
    fs.rename(fresh, target)
    fs.delete(aside, True)


def wide(stm_obs: DataFrame, epochs: list[int], key=("pnt", "obs_type")) -> DataFrame:
    """A column for each listed epoch."""
    return stm_obs.groupBy(*key).pivot("epoch", epochs).agg(F.first("v"))
