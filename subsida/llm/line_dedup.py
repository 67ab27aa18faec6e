"""Line dedup, native: DataFrame functions only.

The keys of long lines are hashed to 128 bits and range-partitioned by (hash, document), and sorted by document and
position within: a window streams over that order and lets the first line of every (hash, document) pass. A hash
that a third of all rows hold is spread over many range partitions, since the document is part of the range key; its
documents are counted from sums that combine before the shuffle.

Decisions leave the operator as run-length compressed keep bitmaps, one per document that loses lines: no text moves
for them. Where texts are to be cut (apply_bitmaps), documents and bitmaps meet in a join by document, which moves each
text once unless the bitmaps are so small that Spark hands them to all tasks.

Null and empty texts have one empty line. A text of any length is split once, and cut in time that grows with its
lines. Rows without a doc_id are neither counted nor changed; repeated rows of a doc_id count as one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subsida.llm.common import LOWER, SPACES, UPPER, materialize, shuffle_partitions

MIN_CHARS = 40
MIN_DOCS = 5
#: Beyond the last line of any text.
END = 2**31 - 1


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_lines(text: Column) -> Column:
    r"""The lines of a text, split at \n; null or empty text has one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.btrim(lower_ascii(line), F.lit(SPACES))


def _same_text(text: Column) -> Column:
    """Tells rows of one doc_id with different texts apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_keys(docs: DataFrame, id_col="doc_id", text_col="text", min_chars=MIN_CHARS) -> DataFrame:
    """(doc_id, row_hash, pos, h1, h2) of every line whose key has at least min_chars code points.

    h1 and h2 are XXH64 under two seeds: 128 bits, so that no two keys of a corpus meet by chance.
    """
    split = F.posexplode(text_lines(F.col(text_col))).alias("pos", "line")
    lines = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), _same_text(F.col(text_col)).alias("row_hash"), split).where(F.length("line") >= min_chars)
    keyed = lines.select("doc_id", "row_hash", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keyed.select("doc_id", "row_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


def first_lines(keys: DataFrame) -> DataFrame:
    """The first line of every hash in every document, from a stream sorted by hash, document and position."""
    ranged = keys.select("h1", "h2", "doc_id", "pos").repartitionByRange(shuffle_partitions(keys.sparkSession), "h1", "h2", "doc_id")
    stream = Window.partitionBy("h1", "h2", "doc_id").orderBy("pos")
    return ranged.withColumn("__nth", F.row_number().over(stream)).where("__nth = 1").drop("__nth")


def keep_bitmaps(docs: DataFrame, id_col="doc_id", text_col="text", min_chars=MIN_CHARS, min_docs=MIN_DOCS) -> DataFrame:
    """Documents that lose lines: (doc_id, row_hash, n_dropped, drop_runs array<struct<start,length>>), a run-length bitmap.

    A key of at least min_chars code points held by at least min_docs distinct documents loses its lines in all
    of them but the largest doc_id. Rows without a doc_id are neither counted nor changed. Repeated rows of one
    doc_id count as one document; each keeps its own bitmap (row_hash tells different texts apart).
    """
    keys = materialize(line_keys(docs, id_col, text_col, min_chars), "line-keys")
    hot = first_lines(keys).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))
    hot = hot.where(F.col("n_docs") >= min_docs).select("h1", "h2", "keeper")
    hot = materialize(hot, "hot-lines")  # of known size: handed to all tasks while small, else a join whose long partitions Spark splits
    drops = keys.join(hot, ["h1", "h2"]).where("doc_id <> keeper")
    pos = drops.groupBy("doc_id", "row_hash").agg(F.array_sort(F.collect_set("pos")).alias("p"))
    starts = F.array_except("p", F.transform("p", lambda x: x + 1))
    ends = F.array_except("p", F.transform("p", lambda x: x - 1))
    runs = F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), (e - s + 1).alias("length")))
    return pos.select("doc_id", "row_hash", F.size("p").cast("long").alias("n_dropped"), runs.alias("drop_runs"))


def kept_text(text: Column, runs: Column) -> Column:
    """The lines outside the runs, joined. The text is split once, and copied by the runs between those of the bitmap."""
    starts = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["start"] + r["length"]))
    ends = F.concat(F.transform(runs, lambda r: r["start"]), F.array(F.lit(END)))
    kept = F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), (e - s).alias("length")))
    cut = lambda lines: F.flatten(F.transform(kept, lambda r: F.slice(lines, r["start"] + 1, r["length"])))
    return F.array_join(F.transform(F.array(text_lines(text)), cut)[0], "\n")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """docs with kept_text, n_lines and n_dropped (columns of these names are replaced); texts meet their bitmaps by document."""
    rows = docs.select(F.col(id_col).alias("id"), _same_text(F.col(text_col)).alias("rh"), F.struct("*").alias("row"))
    b = bitmaps.select(F.col("doc_id").alias("bid"), F.col("row_hash").alias("brh"), "drop_runs", F.col("n_dropped").alias("gone"))
    joined = rows.join(b, (F.col("id") == F.col("bid")) & (F.col("rh") == F.col("brh")), "left").withColumn("t", F.coalesce(F.col("row")[text_col], F.lit("")))
    out = {
        "kept_text": F.when(F.col("drop_runs").isNull(), F.col("t")).otherwise(kept_text(F.col("t"), F.col("drop_runs"))),
        "n_lines": (F.length("t") - F.length(F.translate("t", "\n", "")) + 1).cast("long"),
        "n_dropped": F.coalesce("gone", F.lit(0).cast("long")),
    }
    done = joined.select("row", F.struct(*[v.alias(c) for c, v in out.items()]).alias("made"))
    return done.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in out], "made.*")


def op1_line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document, by keep_bitmaps()."""
    docs = docs.select("doc_id", "text")
    out = apply_bitmaps(docs, keep_bitmaps(docs))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, pos, line, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k
  FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
hot AS (SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT l.doc_id, l.pos, l.line, h.k IS NOT NULL AND l.doc_id <> h.keeper AS gone FROM lines l LEFT JOIN hot h ON l.k = h.k AND length(l.k) >= 40)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
