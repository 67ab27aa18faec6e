"""What the operators of this subpackage share: reading tables and cutting lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The characters that count as white space in the contracts, [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: bytes.translate table that lower-cases A-Z only.
LOWER_TABLE = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
TOKENIZERS = "/opt/tokenizers"
#: Folders of the tables that materialize() has written, in order.
MADE: list[str] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the folder, by Spark's reader alone (the folder may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset, a temporary one, on a single machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="subsida-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and reread it: lineage ends here and survives lost executors.

    The files stay until they are dropped (drop_tables) or the application's folder is removed by cleanup().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    MADE.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_tables(spark: SparkSession, first: int, keep: int = 0) -> None:
    """Remove the tables that materialize() has written, from the first-th on, but for the last `keep`."""
    for folder in MADE[first : len(MADE) - keep]:
        _remove(spark, folder)
    del MADE[first : len(MADE) - keep]


def cleanup(spark: SparkSession) -> None:
    """Remove what materialize() has written in this application."""
    _remove(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
    MADE.clear()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Kept(dict):
    """Values of make(key), kept up to a number of keys; once as many keys again were made in vain, all are forgotten."""

    def __init__(self, make, most: int):
        self.make, self.most, self.vain = make, most, 0

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < self.most:
            self[key] = value
        else:
            self.vain += 1
            if self.vain > self.most:
                self.clear()
                self.vain = 0
        return value


_OWN: dict = {}


def per_process(key, make):
    """make(), once in a Python worker that is used again; another key takes its place, so a worker holds one store."""
    if key not in _OWN:
        _OWN.clear()
        _OWN[key] = make()
    return _OWN[key]
