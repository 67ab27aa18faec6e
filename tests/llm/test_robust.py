"""Cases that once went wrong: short items, repeated ids, letters that are none, files that are mapped, copies side by side."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from subsida.llm import common, decontaminate, jaccard, language_id, mixing, simhash, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ITEMS = "item_id long, text string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)


def test_short_items(spark):
    bench = spark.createDataFrame([(1, "What is 12 plus 30? Answer: 42"), (2, "four"), (3, "a cat sat"), (4, "?!"), (5, "")], ITEMS)
    rows = [(1, "so: what is 12 plus 30, answer 42. And on"), (2, "Four!"), (3, "four words and more"), (4, "a cat satin"), (5, "see a  cat, SAT"), (6, "xa cat sat")]
    got = {(r.doc_id, r.item_id, r.n_tiles, r.min_edits) for r in decontaminate.op9_decontamination(docs(spark, rows), bench).collect()}
    assert got == {(1, 1, 1, 0), (2, 2, 1, 0), (5, 3, 1, 0)}
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs(spark, rows), bench).collect()) == [3, 4, 6]


@pytest.mark.parametrize("size", [1 << 25, 150])
def test_repeated_items_and_null_ids(spark, monkeypatch, size):
    monkeypatch.setattr(decontaminate, "PASS_BYTES", size)
    a, b = ("one passage of the benchmark that is long enough to be searched by its grams " + x for x in ("and ends in a", "and goes on to b"))
    c = "something else altogether, of sufficient length to be an item of its own, without an id"
    bench = spark.createDataFrame([(9, a), (9, a), (9, b), (-1, "nothing that any of these documents would ever hold, not even a part of it"), (None, c), (None, c)], ITEMS)
    rows = [(1, f"x {a} y {b}"), (2, f"z {c}"), (2, f"z {c}"), (3, None), (4, "")]
    got = sorted(((r.doc_id, r.item_id) for r in decontaminate.op9_decontamination(docs(spark, rows), bench).collect()), key=str)
    assert got == [(1, 9), (2, None), (2, None)]
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs(spark, rows), bench).collect()) == [3, 4]


@pytest.mark.parametrize("at", range(0, 40, 7))
def test_passages_between_tiles(at):
    item = " ".join(f"word{i * 37 % 101}" for i in range(60))
    x = decontaminate.normalise(np.frombuffer(f"before it {item[at : at + 100]} after it".encode(), dtype=np.uint8))
    assert decontaminate.Benchmark([(1, item.encode())]).matches(x)


@pytest.mark.parametrize("keep", [simhash.keep_representatives, jaccard.keep_representatives])
def test_one_id_of_several_texts(spark, keep):
    a, b = " ".join(f"apple{i}" for i in range(50)), " ".join(f"berry{i}" for i in range(50))
    for rows in ([(5, a), (7, a), (5, b), (3, b)], [(5, b), (5, a), (3, b), (7, a)], [(5, a), (5, a), (5, b), (3, b), (3, b)]):
        got = sorted((r.doc_id, r.text) for r in keep(docs(spark, rows)).collect())
        assert got == [(3, b), (5, a)]
    clash = docs(spark, [(1, a), (1, a), (None, a), (None, None), (2, None)]).withColumns({c: F.lit(0) for c in ("text_hash", "component_id", "__n", "node", "fp")})
    out = keep(clash)
    assert out.columns == clash.columns and sorted(str(r.doc_id) for r in out.collect()) == ["1", "2", "None", "None"]


def test_numbers_are_no_letters(spark):
    assert language_id.words("½ ² ① a½b x2y _z") == ["a", "b", "x", "y", "z"]
    rows = [(i, "water and bread", "en", "s", 0) for i in range(40)] + [(100, "½ ² ①", "en", "s", 0), (101, "②", None, "s", 0)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.op7_language_id(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[100] == got[101] == ("und", 0.0) and got[1][0] == "en"


def test_the_sample_is_bounded_by_rows_and_labels(spark, monkeypatch):
    rows = [(1, f"bread{chr(97 + i % 26)}", "en", "s", 0) for i in range(50)] + [(i, "water", "en", "s", 0) for i in range(2, 9)] + [(20 + i, "etwas", f"l{i}", "s", 0) for i in range(4)]
    df = spark.createDataFrame(rows, DOCS)
    assert sum(language_id.sample_counts(df, 3)["en"].values()) <= 3
    monkeypatch.setattr(language_id, "LANGUAGES", 2)
    assert len(language_id.sample_counts(df, 3)) <= 2


def test_digest_files_are_mapped_and_shipped_once(spark, tmp_path):
    for rules in ([], [("com/en/", "block")]):
        folder = tmp_path / str(len(rules))
        folder.mkdir()
        url_filter.DigestList.write(str(folder), rules)
        digests = url_filter.DigestList([str(folder / n) for n in url_filter.DigestList.FILES])
        assert not rules or isinstance(digests.keys, np.memmap)
        assert digests.find(["com/en/", "x"]).tolist() == ([0, -1] if rules else [-1, -1])
    pages = spark.createDataFrame([(1, "http://a.com/en/x", "")], "page_id long, url string, html string")
    before = len(url_filter._SHIPPED)
    for _ in range(2):
        assert url_filter.op3_url_filter(pages).first().verdict == "block"
    assert len(url_filter._SHIPPED) <= before + 1


def test_equally_long_rules_go_by_the_longer_host(spark, monkeypatch):
    rules = [("a.b/xy", "block"), ("b/xyzw", "allow")]
    pages = spark.createDataFrame([(1, "http://a.b/xyzw1"), (2, None), (3, "http://c.b/xyzw"), (4, "")], "page_id long, url string")
    want = {1: ("a.b/xy", "block"), 2: (None, "allow"), 3: ("b/xyzw", "allow"), 4: (None, "allow")}
    assert {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules).collect()} == want
    monkeypatch.setattr(url_filter, "MAX_LIST_BYTES", 1)
    assert {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules).collect()} == want


def test_blocks_hold_the_weights_and_no_copies_side_by_side(spark):
    rows = [(i, "w " * 10, "en", "big" if i % 5 else "small", 0) for i in range(1000)]
    got = mixing.schedule(spark.createDataFrame(rows, DOCS), max_repeats=2.0, block_tokens=1000).collect()
    blocks = defaultdict(list)
    for r in got:
        blocks[r.block].append(r)
    whole = Counter(r.source for r in got)
    for of in blocks.values():
        assert sorted(r.position for r in of) == list(range(len(of)))
        assert abs(Counter(r.source for r in of)["small"] - whole["small"] / len(blocks)) <= 1
        assert abs(Counter(r.source for r in of)["big"] - whole["big"] / len(blocks)) <= 1
    line = [r.doc_id for r in sorted(got, key=lambda r: (r.block, r.position))]
    assert max(Counter(line).values()) > 1 and all(a != b for a, b in zip(line, line[1:]))


def test_sources_without_tokens_are_dealt_over_blocks(spark):
    rows = [(i, "w " * 10 if i % 2 else None, "en", "s" if i % 2 else "empty", 0) for i in range(400)]
    got = mixing.schedule(spark.createDataFrame(rows, DOCS), block_tokens=200).where("source = 'empty'").collect()
    assert len(got) == 200 and len({r.block for r in got}) > 5


def test_tables_are_dropped(spark, tmp_path):
    first = len(common.MADE)
    a, b = (common.materialize(spark.range(3), n) for n in ("a", "b"))
    common.drop_tables(spark, first, keep=1)
    assert len(common.MADE) == first + 1 and b.count() == 3
    with pytest.raises(Exception):
        a.count()
