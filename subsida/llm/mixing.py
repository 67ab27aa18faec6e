"""Mixing sources to target weights by temperature.

The token shares p of the sources are raised to an exponent a and normalised: w = p^a / sum p^a. The exponent is
bisected until the most repeated source meets the repetition limit, or until the weights have a target entropy.
Weights are realised as budgeted block permutations: a source's stream is its documents in a seeded permutation,
passed over again until its budget is spent (a last pass takes a prefix); the streams are dealt out evenly
over blocks of block_tokens, so every block holds the sources by their weights, in an order of its own.

A permutation is cut into 4096 hash buckets. Bucket sums give every bucket its offset, and rows are summed within
(source, bucket), so a source of any share of the rows is spread over as many tasks. All in DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subsida.llm.common import materialize

MAX_REPEATS = 1.5
BLOCK_TOKENS = 1_000_000
SEED = 7
STEPS = 100


def word_tokens(text: Column) -> Column:
    r"""Tokens as runs of characters other than [\x20\x09-\x0D]; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def permutation_key(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))


def bisect_repeats(largest: float, smallest: float, max_repeats: float) -> float:
    """The exponent at which the smallest source is repeated max_repeats times while the largest is read once."""
    lo, hi = 0.0, 1.0
    if largest <= smallest or (largest / smallest) ** (1 - lo) <= max_repeats:
        return lo
    for _ in range(STEPS):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (largest / smallest) ** (1 - mid) > max_repeats else (lo, mid)
    return hi


def search_entropy(totals: DataFrame, target: float, sections: int = 32, rounds: int = 6) -> float:
    """The largest exponent in [0, 1] whose weights have at least the target entropy (nats); 0 if none has.

    Bisection by sections: each round is one aggregate over the sources with `sections` exponents side by side, so
    sources are never collected.
    """
    lo, hi = 0.0, 1.0
    whole = totals.agg(F.sum("t")).first()[0]
    logp = F.log(F.col("t") / F.lit(float(whole)))
    for _ in range(rounds):
        grid = [lo + (hi - lo) * i / sections for i in range(sections + 1)]
        row = totals.where("t > 0").agg(*[f for a in grid for f in (F.sum(F.exp(logp * a)), F.sum(F.exp(logp * a) * logp * a))]).first()
        entropy = [math.log(row[2 * i]) - row[2 * i + 1] / row[2 * i] for i in range(len(grid))]
        ok = [i for i, h in enumerate(entropy) if h >= target]
        if not ok:
            return grid[0]
        if max(ok) == sections:
            return grid[-1]
        lo, hi = grid[max(ok)], grid[max(ok) + 1]
    return lo


def plan(docs: DataFrame, max_repeats: float | None = MAX_REPEATS, target_entropy: float | None = None, budget: int | None = None) -> DataFrame:
    """(source, t, weight, goal) of every source of docs (source, n): tokens, weight and token budget.

    With max_repeats every source is read once at least and max_repeats times at most; without a budget, the same
    holds of the lower end for target_entropy: the least repeated source is read once. A budget sets the tokens in all.
    Sources without a token get no weight; their documents are read once.
    """
    totals = materialize(docs.groupBy("source").agg(F.sum("n").alias("t")), "source-tokens")
    top, low, whole = totals.where("t > 0").agg(F.max("t"), F.min("t"), F.sum("t")).first()
    if not top:
        return totals.withColumn("weight", F.lit(0.0)).withColumn("goal", F.lit(0).cast("long"))
    a = search_entropy(totals, target_entropy) if target_entropy is not None else bisect_repeats(float(top), float(low), max_repeats)
    norm = totals.where("t > 0").agg(F.sum(F.pow(F.col("t") / F.lit(float(whole)), F.lit(a)))).first()[0]
    weighted = totals.withColumn("weight", F.when(F.col("t") > 0, F.pow(F.col("t") / F.lit(float(whole)), F.lit(a)) / F.lit(norm)).otherwise(0.0))
    if budget is None:  # the source of the largest share is read once
        goal = F.pow(F.col("t") / F.lit(float(top)), F.lit(a)) * F.lit(float(top))
    else:
        goal = F.col("weight") * F.lit(float(budget))
    return weighted.withColumn("goal", F.when(F.col("t") > 0, F.floor(goal + 0.5)).otherwise(0).cast("long"))


def _streams(docs: DataFrame, seed: int) -> DataFrame:
    """docs (doc_id, source, n) with key and cum, the tokens of the source's permutation up to the document."""
    keyed = docs.withColumn("key", permutation_key(F.col("doc_id"), seed)).withColumn("bucket", F.conv(F.substring("key", 1, 3), 16, 10).cast("int"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keyed.groupBy("source", "bucket").agg(F.sum("n").alias("s")).withColumn("offset", F.coalesce(F.sum("s").over(before), F.lit(0))).drop("s")
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id")  # repeated rows of a document go together
    return keyed.withColumn("cum", F.sum("n").over(within)).join(offsets, ["source", "bucket"]).withColumn("cum", F.col("cum") + F.col("offset")).drop("offset", "bucket")


def _prepared(docs: DataFrame, tokens: Column | None) -> DataFrame:
    n = word_tokens(F.col("text")) if tokens is None else tokens
    return materialize(docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), n.alias("n")), "mixing-tokens")


def _dealt(rows: DataFrame, max_repeats: float | None, target_entropy: float | None, budget: int | None, block_tokens: int, seed: int) -> DataFrame:
    """rows (doc_id, source, n) with copies, the times that a document is read, and what _block() needs."""
    goals = plan(rows, max_repeats, target_entropy, budget)
    whole = goals.agg(F.sum("goal")).first()[0] or 0
    blocks = max(1, -(-int(whole) // block_tokens))
    dealt = _streams(rows, seed).join(goals.select("source", "t", "goal"), "source")
    passes = F.when(F.col("t") > 0, (F.col("goal") / F.col("t")).cast("long") + F.when(F.col("cum") <= F.col("goal") % F.col("t"), 1).otherwise(0)).otherwise(1)
    return dealt.withColumn("copies", passes).withColumn("blocks", F.lit(blocks))


def _block(copy: str = "copy", of: str = "") -> Column:
    """The block of a copy: streams are dealt out evenly over all blocks. `of` is put before the names of _dealt()."""
    t, cum, n, goal, blocks = (F.col(of + c) for c in ("t", "cum", "n", "goal", "blocks"))
    at = (F.col(copy) * t + cum - n).cast("double") * blocks.cast("double") / goal.cast("double")
    spread = F.conv(F.substring(of + "key", 1, 8), 16, 10).cast("long") % blocks  # sources without a token
    return F.when(goal > 0, F.least(F.floor(at), blocks - 1)).otherwise(spread).cast("long")


def _order(block: str, doc_id: str, copy: str) -> Column:
    """What copies are ordered by within a block."""
    return F.md5(F.concat_ws(":", F.col(block).cast("string"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.col(copy).cast("string")).cast("binary"))


def schedule(docs: DataFrame, max_repeats: float | None = MAX_REPEATS, target_entropy: float | None = None, budget: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = SEED, tokens: Column | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, copy, block, position): one row for every time that a document is read.

    A null source counts as the source ''. A document without tokens is read as often as those around it; sources without
    a token are dealt over all blocks. Rows of one doc_id stand together in the permutation and are taken or left
    together. position counts from 0 within a block, in the order of md5(block:doc_id:copy). An empty table gives an empty schedule.
    """
    rows = _prepared(docs, tokens)
    dealt = _dealt(rows, max_repeats, target_entropy, budget, block_tokens, seed)
    copies = dealt.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    placed = copies.select("doc_id", "source", F.col("n").alias("n_tokens"), "copy", _block().alias("block"))
    nth = F.row_number().over(Window.partitionBy("block").orderBy(_order("block", "doc_id", "copy"), "source", "n_tokens"))
    return placed.withColumn("position", nth.cast("long") - 1)


def mix(docs: DataFrame, max_repeats: float | None = MAX_REPEATS, target_entropy: float | None = None, budget: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = SEED, tokens: Column | None = None) -> DataFrame:
    """docs with every row as often as schedule() reads it, in the order of its blocks and, within a block, of md5(block:doc_id:copy).

    Partitions are ranges of that order, so what is written and read again holds the sources by their weights throughout.
    """
    rows = _prepared(docs, tokens)
    dealt = _dealt(rows, max_repeats, target_entropy, budget, block_tokens, seed).distinct()  # repeated rows of a document have the same place
    dealt = dealt.where("copies > 0").select("doc_id", "source", "n", F.struct("cum", "n", "t", "goal", "blocks", "copies", "key").alias("__at"))
    dealt = materialize(dealt.select(F.col("doc_id").alias("__id"), F.col("source").alias("__s"), F.col("n").alias("__m"), "__at"), "mixing-places")
    n = word_tokens(F.col("text")) if tokens is None else tokens
    here = docs.withColumn("__source", F.coalesce(F.col("source").cast("string"), F.lit(""))).withColumn("__n", n)
    joined = here.join(dealt, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__source") == F.col("__s")) & F.col("__n").eqNullSafe(F.col("__m")))
    copies = joined.withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__at.copies") - 1)))
    placed = copies.withColumn("__block", _block("__copy", "__at.")).withColumn("__key", _order("__block", "doc_id", "__copy")).select(*docs.columns, "__block", "__key")
    return placed.repartitionByRange("__block", "__key").sortWithinPartitions("__block", "__key").select(*docs.columns)


def op5_mixing(docs: DataFrame) -> DataFrame:
    return schedule(docs.select("doc_id", "text", "source"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n,
             md5(coalesce(doc_id::VARCHAR, '') || ':7') AS key FROM documents),
totals AS (SELECT source, sum(n)::BIGINT AS t FROM d GROUP BY source),
ends AS (SELECT max(t)::DOUBLE AS top, min(t)::DOUBLE AS low FROM totals WHERE t > 0),
a AS (SELECT CASE WHEN top / low <= 1.5 THEN 0.0 ELSE 1 - ln(1.5) / ln(top / low) END AS a, top FROM ends),
goals AS (SELECT source, t, CASE WHEN t > 0 THEN floor(pow(t / top, a) * top + 0.5) ELSE 0 END::BIGINT AS goal FROM totals, a),
blocks AS (SELECT greatest(1, ceil(sum(goal) / 1000000.0))::BIGINT AS k FROM goals),
streams AS (SELECT d.*, sum(n) OVER (PARTITION BY source ORDER BY key, doc_id)::BIGINT AS cum FROM d),
copies AS (SELECT s.doc_id, s.source, s.n, s.cum, s.key, g.t, g.goal,
             unnest(range(CASE WHEN t > 0 THEN goal // t + CASE WHEN cum <= goal % t THEN 1 ELSE 0 END ELSE 1 END)) AS copy
           FROM streams s JOIN goals g USING (source)),
placed AS (SELECT doc_id, source, n AS n_tokens, copy,
             CASE WHEN goal > 0 THEN least(floor((copy * t + cum - n)::DOUBLE * k::DOUBLE / goal::DOUBLE), k - 1) ELSE ('0x' || substr(key, 1, 8))::BIGINT % k END::BIGINT AS block
           FROM copies, blocks)
SELECT *, row_number() OVER (PARTITION BY block ORDER BY md5(block::VARCHAR || ':' || coalesce(doc_id::VARCHAR, '') || ':' || copy::VARCHAR), source, n_tokens)::BIGINT - 1 AS position FROM placed
"""
