"""Arguments of the modules: options, input lists, and whether an output has to be made."""

from __future__ import annotations

import warnings
from dataclasses import fields, is_dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def merge(defaults, given=None):
    """defaults (dict or dataclass) with those given, as a mapping or a flat list of names and values; unknown names are warned of and left out."""
    if given is None:
        return defaults
    given = dict(zip(given[::2], given[1::2])) if isinstance(given, (list, tuple)) else dict(given)
    known = {f.name for f in fields(defaults)} if is_dataclass(defaults) else set(defaults)
    for k in given.keys() - known:
        warnings.warn(f"unknown option {k} is ignored", stacklevel=2)
    given = {k: v for k, v in given.items() if k in known}
    return replace(defaults, **given) if is_dataclass(defaults) else {**defaults, **given}


def input_files(spark: SparkSession, source: str | list[str], section: str | None = None) -> list[str]:
    """Names from a list, a wildcard, or a list file: blank lines and lines with #, % are skipped, [section] heads a part."""
    if isinstance(source, (list, tuple)):
        return list(source)
    if any(c in source for c in "*?["):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
        found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
        return sorted(f.getPath().toString() for f in found)
    rows = list_lines(spark, source)
    if section is not None:
        rows = rows.where(F.lower("section") == section.lower())
    return [r.line for r in rows.orderBy("i").collect()]  # a list of file names


def list_lines(spark: SparkSession, path: str) -> DataFrame:
    """(i, section, line) of the names in a list file."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("i", "line")).withColumn("line", F.trim("line"))
    head = F.when(F.col("line").rlike(r"^\[.*\]$"), F.expr("substring(line, 2, length(line) - 2)"))
    s = lines.withColumn("section", F.last(head, ignorenulls=True).over(Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))  # one file's lines
    return s.where(~F.col("line").rlike(r"^$|^[#%\[]")).select("i", "section", "line")


def modified(spark: SparkSession, path: str) -> int | None:
    """Time of last change in milliseconds, of the newest file below; None if there is nothing."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    if not fs.getFileStatus(p).isDirectory():
        return fs.getFileStatus(p).getModificationTime()
    it, latest = fs.listFiles(p, True), 0
    while it.hasNext():
        latest = max(latest, it.next().getModificationTime())
    return latest


def needs_run(spark: SparkSession, inputs: list[str], output: str, flag: str = "create") -> bool:
    """create: an error if the output exists; update: only if an input is newer; overwrite: always."""
    there = modified(spark, output)
    if flag == "overwrite" or there is None:
        return True
    if flag == "create":
        raise FileExistsError(output)
    if flag == "update":
        return any((modified(spark, i) or 0) > there for i in inputs)
    raise ValueError(f"unknown flag {flag}")
