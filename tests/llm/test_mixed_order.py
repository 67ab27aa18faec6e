"""The pipeline's mixing stage realises the blocks of schedule()."""

import random
from collections import Counter

import corpus_pipeline
from subsida.llm import mixing
from tests.llm.test_text_operators import docs


def test_copies_stand_in_the_order_of_blocks(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(["word"] * rng.randrange(20, 60))) for i in range(600)]
    table = docs(spark, rows).drop("source").selectExpr("*", "case when doc_id < 400 then 'a' when doc_id < 570 then 'b' end as source").coalesce(1)
    mixing.mix(table, block_tokens=2000).write.parquet(str(tmp_path / "mixed"))
    read = []
    for f in sorted((tmp_path / "mixed").glob("part-*.parquet")):
        read += [r.doc_id for r in spark.read.parquet(str(f)).coalesce(1).collect()]
    plan = mixing.schedule(table, block_tokens=2000).selectExpr("doc_id", "block", "md5(cast(concat_ws(':', block, doc_id, copy) as binary)) as key").collect()
    want = [r.doc_id for r in sorted(plan, key=lambda r: (r.block, r.key))]
    assert len({r.block for r in plan}) > 8 and read == want


def test_stage_counts_and_repeated_rows(spark):
    rows = [(i, "one two three " * (1 + i % 4)) for i in range(60)] + [(3, "one two three " * 4), (None, "a b"), (None, "a b"), (None, None)]
    table = docs(spark, rows)
    got = Counter(r.doc_id for r in corpus_pipeline.mix_sources(spark, table, "").collect())
    assert got == Counter(r.doc_id for r in mixing.schedule(table).collect())
