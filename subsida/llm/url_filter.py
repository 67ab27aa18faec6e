"""URL filter by a sorted digest array.

The 64-bit XXH64 keys of all rules stand sorted in one array file, beside their full strings; executors
memory-map the files, probe them with a vectorised binary search, and confirm the full string of every hit, so
colliding digests decide nothing. A rule is a host and a path prefix, written as one string like `example.com/en/`.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subsida.llm.common import LOWER, UPPER, per_process

#: Bytes of digest files that are handed to every executor; longer lists are joined instead.
MAX_LIST_BYTES = 1 << 30
#: Fixed rules of the query.
RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or a url without ://."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    ends = [i for c in "?#" if (i := rest.find(c)) >= 0]
    rest = rest[: min(ends)] if ends else rest
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.translate(_LOWER), path


_LOWER = {c: c + 32 for c in range(65, 91)}


def host_of(url: Column) -> Column:
    """The host as split_url() gives it, by built-in expressions."""
    at = F.locate("://", url)
    host = F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"(?s)^([^/?#]*)", 1)
    return F.when(F.coalesce(at > 0, F.lit(False)), F.translate(host, UPPER, LOWER)).otherwise("")


def _key(s: str) -> int:
    return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), 0)


def _mapped(path: str) -> np.ndarray:
    try:
        return np.load(path, mmap_mode="r")
    except ValueError:  # an empty array can't be mapped
        return np.load(path)


class DigestList:
    """Sorted keys, string offsets, strings, verdicts and path lengths, as files that can be memory-mapped."""

    FILES = ("keys.npy", "offsets.npy", "strings.npy", "verdicts.npy", "lengths.npy")

    @staticmethod
    def write(folder: str, rules: Iterable[tuple[str, str]]) -> int:
        """Write the files for (rule, verdict) pairs; of repeated rules the last counts. Returns their bytes."""
        rows = sorted((_key(r), r.encode(), v == "block", len(r) - len(r.partition("/")[0])) for r, v in dict(rules).items())
        strings = [r[1] for r in rows]
        arrays = (
            np.array([r[0] for r in rows], dtype=np.uint64),
            np.cumsum([0, *map(len, strings)], dtype=np.int64),
            np.frombuffer(b"".join(strings), dtype=np.uint8),
            np.array([r[2] for r in rows], dtype=np.uint8),
            np.array(sorted({r[3] for r in rows}), dtype=np.int64),
        )
        for name, a in zip(DigestList.FILES, arrays):
            np.save(os.path.join(folder, name), a)
        return sum(a.nbytes for a in arrays)

    def __init__(self, paths: list[str]):
        self.keys, self.offsets, self.strings, self.verdicts, lengths = map(_mapped, paths)
        self.lengths = [int(n) for n in lengths]

    def find(self, candidates: list[str]) -> np.ndarray:
        """The position of each candidate in the list, -1 if it isn't there."""
        out = np.full(len(candidates), -1, dtype=np.int64)
        if not len(self.keys) or not candidates:
            return out
        keys = np.fromiter(map(_key, candidates), dtype=np.uint64, count=len(candidates))
        at = np.searchsorted(self.keys, keys)
        for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == keys):
            want, k = candidates[i].encode("utf-8", "surrogatepass"), int(at[i])
            while k < len(self.keys) and self.keys[k] == keys[i]:  # equal digests stand together
                if self.strings[self.offsets[k] : self.offsets[k + 1]].tobytes() == want:
                    out[i] = k
                    break
                k += 1
        return out


def candidates(host: str, path: str, lengths: list[int]) -> list[str]:
    """Every rule string that would fit: host suffixes at dots, and path prefixes of the lengths that rules have."""
    labels = host.split(".")
    hosts = [".".join(labels[i:]) for i in range(len(labels))]
    return [h + path[:n] for h in hosts for n in lengths if n <= len(path)]


#: Digest files that were handed to the executors of an application: their folder (removed at exit) and names.
_SHIPPED: dict[tuple[str, str], tuple[tempfile.TemporaryDirectory, list[str]]] = {}


def _shipped(spark: SparkSession, rules: dict[str, str]) -> list[str]:
    """The names of the digest files of the rules; equal lists are handed to the executors once."""
    tag = hashlib.sha256(repr(sorted(rules.items())).encode("utf-8", "surrogatepass")).hexdigest()[:32]
    key = (spark.sparkContext.applicationId, tag)
    if key not in _SHIPPED:
        folder = tempfile.TemporaryDirectory(prefix="digests-")
        DigestList.write(folder.name, rules.items())
        names = [f"{tag}-{name}" for name in DigestList.FILES]
        for name, tagged in zip(DigestList.FILES, names):
            os.rename(os.path.join(folder.name, name), os.path.join(folder.name, tagged))
            spark.sparkContext.addFile(os.path.join(folder.name, tagged))
        _SHIPPED[key] = folder, names
    return _SHIPPED[key][1]


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str]], id_col="page_id", url_col="url", default="allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row.

    The longest rule that fits the url decides, of equally long ones that of the longer host; where none does, rule is null
    and the verdict is `default`, as the url is in no list. Null urls and urls without :// have an empty host and path,
    and fit no rule. Rows are returned as often as they occur. Lists over MAX_LIST_BYTES go to judge_urls_joined().
    """
    spark, rules = pages.sparkSession, dict(rules)
    if sum(map(len, rules)) + 32 * len(rules) > MAX_LIST_BYTES:
        return judge_urls_joined(pages, spark.createDataFrame(list(rules.items()), "rule string, verdict string"), id_col, url_col, default)
    names = _shipped(spark, rules)
    key_type = dict(pages.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = per_process(("digests", names[0]), lambda: DigestList([SparkFiles.get(n) for n in names]))
        for b in batches:
            parts = [split_url(u) for u in b.column(1).to_pylist()]
            tried = [candidates(h, p, digests.lengths) for h, p in parts]
            flat = list(dict.fromkeys(c for t in tried for c in t))
            hits = {c: int(k) for c, k in zip(flat, digests.find(flat)) if k >= 0}
            best = [max((c for c in t if c in hits), key=len, default=None) for t in tried]
            verdicts = [default if r is None else ("block" if digests.verdicts[hits[r]] else "allow") for r in best]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), pa.array(best, pa.string()), pa.array(verdicts, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")).mapInArrow(run, f"page_id {key_type}, host string, path string, rule string, verdict string")


def judge_urls_joined(pages: DataFrame, rules: DataFrame, id_col="page_id", url_col="url", default="allow") -> DataFrame:
    """As judge_urls(), for a table of rules (rule, verdict) of any size: candidates meet rules in an equi-join.

    Candidates are made distinct before the join, so that a host of many pages adds no more than its distinct paths.
    """
    url = F.col(url_col)
    after = F.substring(url, F.locate("://", url) + 3, F.length(url))
    has = F.coalesce(F.locate("://", url) > 0, F.lit(False))
    parts = pages.select(
        F.col(id_col).alias("page_id"),
        host_of(url).alias("host"),
        F.when(has, F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise("").alias("path"),
    )
    sized = rules.select("rule", "verdict", (F.length("rule") - F.length(F.substring_index("rule", "/", 1))).alias("n"))
    lengths = sized.agg(F.array_sort(F.collect_set("n")).alias("lengths"))
    distinct = parts.select("host", "path").distinct().crossJoin(F.broadcast(lengths))  # one row: the distinct lengths
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    tried = distinct.select("host", "path", F.explode(hosts).alias("h"), "lengths").select("host", "path", "h", F.explode("lengths").alias("n")).where("n <= length(path)")
    tried = tried.select("host", "path", F.concat("h", F.expr("substring(path, 1, n)")).alias("rule"))
    best = tried.join(sized.select("rule", "verdict"), "rule").groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), F.length(F.substring_index("rule", "/", 1)))).alias("b"))
    out = parts.join(best, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict"))


def op3_url_filter(pages: DataFrame) -> DataFrame:
    return judge_urls(pages.select("page_id", "url"), RULES)


ORACLE = r"""
WITH parts AS (
  SELECT page_id,
    CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
rules(rule, h, p, v) AS (VALUES ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'), ('net/de/', 'net', '/de/', 'allow'),
  ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')),
judged AS (
  SELECT page_id, host, path, (SELECT r.rule FROM rules r WHERE (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p) ORDER BY length(r.rule) DESC LIMIT 1) AS rule
  FROM parts)
SELECT page_id, host, path, rule, coalesce((SELECT v FROM rules r WHERE r.rule = judged.rule), 'allow') AS verdict FROM judged
"""
