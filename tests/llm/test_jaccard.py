"""The pipeline's near copies against brute force."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from subsida.llm import jaccard, simhash
from tests.llm.test_text_operators import docs


def near_rows():
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(4000)}"
    rows = []
    for g in range(12):
        base = [word() for _ in range(rng.choice([8, 40, 120, 400]))]
        for _ in range(rng.choice([3, 8, 90 if g == 0 else 12])):
            own = list(base)
            for _ in range(rng.randrange(1 + len(own) // 25)):
                own[rng.randrange(len(own))] = word()
            rows.append((len(rows), " ".join(own)))
    base = [word() for _ in range(200)]
    for _ in range(100):
        own = list(base)
        for _ in range(rng.choice([1, 2, 9])):
            own[rng.randrange(len(own))] = word()
        rows.append((len(rows), " ".join(own)))
    return rows


def brute_force(rows):
    sets = {}
    for i, text in rows:
        words = text.lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: top(i) for i in sets}


@pytest.mark.parametrize("long", [5, 64])
def test_similar_groups_equal_brute_force(spark, long):
    rows = near_rows()
    got = {r.doc_id: r.component_id for r in jaccard.similar_groups(docs(spark, rows), long).collect()}
    want = brute_force(rows)
    assert got == want and 12 < len(set(want.values())) < len(rows)


def test_stage_keeps_one_of_each_group(spark):
    rows = near_rows()
    extra = [(9000, None), (9001, "  "), (None, rows[0][1]), rows[0]]
    kept = corpus_pipeline.drop_near_copies(spark, docs(spark, rows + extra), "")
    want = set(brute_force(rows).values()) | {9000, -1}
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == sorted(want)


def exactly_at_the_limit(n):
    """Pairs of texts of 4 to 80 shingles at similarity 0.8, or just over it: one word more at the end for every four shingles."""
    rng = random.Random(5)
    word = lambda: f"v{rng.randrange(10**9)}"
    rows = []
    for k in range(n):
        size = rng.choice([4, 8, 20, 80])
        base = [word() for _ in range(size + 4)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base + [word() for _ in range(size // 4)]))]
    return rows


def nodes_of(df):
    rows = jaccard.sketches(df).cache()
    rep = F.min(F.struct(*jaccard._key(), F.col("text_hash").alias("__hash"))).alias("rep")
    return rows, rows.groupBy("node").agg(rep, *[F.first(c).alias(c) for c in rows.columns if c not in ("doc_id", "text_hash", "node")]).cache()


def test_pairs_at_the_limit_meet_by_bytes_of_fingerprints(spark, monkeypatch):
    rows = exactly_at_the_limit(400)
    df = docs(spark, rows)
    sketches, nodes = nodes_of(df)
    node = {r.doc_id: r.node for r in sketches.collect()}
    fps = {r.node: r.fp for r in nodes.collect()}
    met = {(r.a, r.b) for r in jaccard.meetings(nodes).collect()}
    for k in range(400):
        a, b = sorted((node[2 * k], node[2 * k + 1]))
        assert (a, b) in met and sum(x == y for x, y in zip(fps[a], fps[b])) >= jaccard.SHARED
    assert len(met) < 410  # and hardly anything else
    monkeypatch.setattr(jaccard, "meetings", lambda nodes, *_: nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0))
    assert corpus_pipeline.drop_near_copies(spark, df, "").count() == len(rows)  # the index is the only way to a pair


def test_groups_yield_forests(spark):
    rng = random.Random(6)
    base = [f"u{i}" for i in range(300)]
    rows = []
    for i in range(200):
        own = list(base)
        own[rng.randrange(300)] = own[rng.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(own)))
    df = docs(spark, rows)
    sketches, nodes = nodes_of(df)
    n = nodes.count()
    assert n == 200 and jaccard.similar_pairs(df, sketches, nodes).count() == n - 1


def test_slices_and_blocks_lose_nothing(spark):
    rows = near_rows()
    got = {r.doc_id: r.component_id for r in jaccard.similar_groups(docs(spark, rows), 4, 60, 2500).collect()}
    assert got == brute_force(rows)


def test_texts_move_once_for_the_result(spark, monkeypatch):
    monkeypatch.setattr(simhash, "materialize", lambda df, name: df.sparkSession.createDataFrame(df.collect(), df.schema))
    members = spark.createDataFrame([(1, 5, 1), (2, 5, 1)], "doc_id long, text_hash long, component_id long")
    plan = simhash.keep_one(docs(spark, [(1, "a"), (2, "a")]), members)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1
