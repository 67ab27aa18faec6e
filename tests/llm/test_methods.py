"""That operators go by their methods: what plans hold, what is processed, what grows how."""

import re
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from subsida.llm import line_dedup, topk

DOCS = "doc_id long, text string"
LINE = "The same long notice, which stands in many documents of this corpus."


def test_lines_are_sorted_by_document_and_position(spark):
    keys = line_dedup.line_keys(spark.createDataFrame([(i, LINE) for i in range(5)], DOCS))
    plan = line_dedup.first_lines(keys)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and "row_number" in plan
    physical = line_dedup.first_lines(keys)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Sort \[h1#\d+L ASC NULLS FIRST, h2#\d+L ASC NULLS FIRST, doc_id#\d+L ASC NULLS FIRST, pos#\d+ ASC", physical)
    assert physical.count("Exchange") == physical.count("Exchange rangepartitioning") == 1


def test_first_lines(spark):
    rows = [(i, "\n".join(["x", LINE, "y" * 50, LINE])) for i in range(6)]
    firsts = line_dedup.first_lines(line_dedup.line_keys(spark.createDataFrame(rows, DOCS))).collect()
    assert sorted((r.doc_id, r.pos) for r in firsts) == sorted((i, p) for i in range(6) for p in (1, 2))


def test_long_texts_are_cut_in_time_that_grows_with_their_lines(spark):
    took = {}
    for n in (2_000, 32_000):
        rows = [(i, "\n".join([LINE] + [f"{i} own line {k}" for k in range(n)] + [LINE])) for i in range(6)]
        df = spark.createDataFrame(rows, DOCS).cache()
        df.count()
        maps = line_dedup.keep_bitmaps(df).cache()
        maps.count()
        began = time.time()
        got = {r.doc_id: r for r in line_dedup.apply_bitmaps(df, maps).collect()}
        took[n] = time.time() - began
        assert got[0].kept_text == rows[0][1][len(LINE) + 1 : -len(LINE) - 1] and got[0].n_lines == n + 2 and got[0].n_dropped == 2
        assert got[5].kept_text == rows[5][1] and got[5].n_dropped == 0
    assert took[32_000] < 16 * took[2_000] + 5


def test_lines_at_the_edges(spark):
    rows = [(i, LINE + "\n" + LINE) for i in range(5)] + [(7, "\n"), (8, "a\n"), (None, LINE)]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("z") for c in ("kept_text", "n_lines", "n_dropped", "drop_runs", "__id")})
    got = {r.doc_id: (r.kept_text, r.n_lines, r.n_dropped) for r in line_dedup.apply_bitmaps(df, line_dedup.keep_bitmaps(df)).collect()}
    assert got[0] == ("", 2, 2) and got[4] == (LINE + "\n" + LINE, 2, 0) and got[7] == ("\n", 2, 0) and got[8] == ("a\n", 2, 0) and got[None] == (LINE, 1, 0)


def test_segments_are_processed_by_impact_and_searches_stop_early():
    rng = np.random.default_rng(1)
    v = np.floor(8 * rng.normal(size=(3000, 64)))
    index, work = topk.ImpactIndex(np.arange(3000), v), {}
    largest = [max(float(np.abs(values).max()) for _, _, values in segments) for segments, *_ in index.levels]
    assert largest == sorted(largest, reverse=True) and index.postings == np.count_nonzero(v)
    assert all(len(set(rows.tolist())) == len(rows) for segments, *_ in index.levels for _, rows, _ in segments)
    at, ids, scores = index.search(v[:100], np.arange(100), 20, work)
    assert work["processed"] < 0.9 * 100 * index.postings and work["rescored"] < 0.2 * 100 * 3000
    exact = (v[:100] @ v.T).astype(np.int64)
    for q in range(100):
        best = sorted((i for i in range(3000) if i != q), key=lambda i: (-exact[q, i], i))[:20]
        assert ids[at == q].tolist() == best and scores[at == q].tolist() == [exact[q, i] for i in best]


@pytest.mark.parametrize("rows", [1, 2, 20, 21, 22])
def test_few_rows(rows):
    v = np.arange(rows * 3).reshape(rows, 3).astype(float)
    at, ids, scores = topk.ImpactIndex(np.arange(rows), v).search(v, np.arange(rows), 20)
    assert len(at) == rows * min(20, rows - 1)


def test_equal_rows_take_bounded_memory():
    v = np.tile(np.arange(64.0), (4096, 1))
    tracemalloc.start()
    at, ids, scores = topk.ImpactIndex(np.arange(4096), v).search(v[:256], np.arange(256), 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6 and ids[at == 0].tolist() == list(range(1, 21)) and ids[at == 5].tolist() == [0, 1, 2, 3, 4, *range(6, 21)]


def test_numbers_of_any_size(spark):
    rows = [(0, [3e37, -3e37]), (20, [3e37, 3e37]), (1, [1.0, 1.0]), (2, [-3e37, 1.0]), (3, [0.0, 0.0]), (4, [3e38, 3e38])]
    got = topk.op8_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("query_id = 20").orderBy("rank").collect()
    assert [r.vec_id for r in got] == [4, 1, 0, 3, 2] and got[0].score == topk.LARGEST_LONG and got[2].score == 0 and got[-1].score == topk.LEAST_LONG
