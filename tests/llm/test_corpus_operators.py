"""URL filter, mixing, packing, top-k search, HTML extraction and the pipeline: against brute force, and at the edges."""

import html
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from subsida.llm import html_extract, mixing, packing, topk, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PAGES = "page_id long, url string, html string"


def brute_rule(host, path):
    fits = [r for r, _ in url_filter.RULES if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith(r[len(r.partition("/")[0]) :])]
    best = max(fits, key=len, default=None)
    return best, dict(url_filter.RULES).get(best, "allow")


def test_urls(spark):
    rng = random.Random(1)
    urls = [None, "", "no scheme", "http://", "HTTP://A.COM/en/", "x://EXAMPLE.com/en/7?q", "x://com/en/", "x://a.example.com#f/en/", "x://notexample.com/en/7", "x://u@a.org/es/é", "x://example.net/de/8://", "a?b://c.net/de/9"]
    urls += ["s://" + rng.choice(["", "a.", "b.c."]) + rng.choice(["example", "sample", "net"]) + rng.choice([".com", ".net", ".org", ""]) + rng.choice(["", "/en", "/en/", "/en/7", "/en/71", "/de/8", "/de/", "/es/x"]) + rng.choice(["", "?q=/en/", "#top"]) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(urls)) + [(None, "x://a.com/en/1"), (3, "http://")], "page_id long, url string").withColumns({c: F.lit("x") for c in ("host", "rule", "verdict")})
    for got in (url_filter.op3_url_filter(df), url_filter.judge_urls_joined(df, spark.createDataFrame(url_filter.RULES, "rule string, verdict string"))):
        rows = got.collect()
        assert len(rows) == len(urls) + 2
        for r in rows:
            if r.page_id is None or r.page_id == 3:
                continue
            u = urls[r.page_id]
            rest = u.split("://", 1)[1] if u and "://" in u else ""
            cut = min([i for c in "?#" if (i := rest.find(c)) >= 0], default=len(rest))
            host, slash, path = rest[:cut].partition("/")
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
            assert (r.host, r.path, r.rule, r.verdict) == (host, slash + path, *brute_rule(host, slash + path)), u


def test_digest_list_confirms_strings(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter, "_key", lambda s: len(s))  # every string of a length collides
    url_filter.DigestList.write(str(tmp_path), [("aa/x", "block"), ("bb/x", "allow"), ("c/", "block")])
    d = url_filter.DigestList([str(tmp_path / n) for n in url_filter.DigestList.FILES])
    assert [bool(k >= 0) for k in d.find(["aa/x", "bb/x", "cc/x", "c/", "zzzzzzz"])] == [True, True, False, True, False]


def mixed(spark, n=300, seed=2):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, " ".join(["w"] * rng.randint(0, 40)), "en", "big" if i % 3 else rng.choice(["a", "b", None, "c"]), 1) for i in range(n)], DOCS)


def test_mixing_weights_and_budget(spark):
    df = mixed(spark)
    rows = mixing.schedule(df, max_repeats=2.5, block_tokens=500).collect()
    total, once = Counter(), Counter()
    for r in rows:
        total[r.source] += r.n_tokens
        if r.copy == 0:
            once[r.source] += r.n_tokens
    big, low = max(once.values()), min(once.values())
    a = 1 - math.log(2.5) / math.log(big / low)
    for s, t in once.items():
        goal = math.floor((t / big) ** a * big + 0.5)
        assert goal - 40 <= total[s] <= goal and total[s] >= t  # the budget, less at most one document
    assert len({r.doc_id for r in rows}) == 300  # every document once at least
    assert total[min(once, key=once.get)] <= 2.5 * low
    blocks = defaultdict(Counter)
    for r in rows:
        blocks[r.block][r.source] += r.n_tokens
    whole = sum(total.values())
    for b in list(blocks.values())[:-1]:  # each block holds the sources by their weights
        assert abs(b["big"] / sum(b.values()) - total["big"] / whole) < 0.25
    assert Counter(r.doc_id for r in mixing.mix(df, max_repeats=2.5).collect()) == Counter(r.doc_id for r in rows)


def test_mixing_target_entropy_and_budget(spark):
    rows = mixing._prepared(mixed(spark), None)
    target = 1.2
    w = [r.weight for r in mixing.plan(rows, None, target).collect()]
    assert sum(w) == pytest.approx(1) and -sum(x * math.log(x) for x in w) == pytest.approx(target, abs=1e-3)
    assert sum(r.goal for r in mixing.plan(rows, 1.5, None, 1000).collect()) == pytest.approx(1000, abs=5)


def test_mixing_bisection():
    a = mixing.bisect_repeats(1000.0, 10.0, 4.0)
    assert (1000 / 10) ** (1 - a) == pytest.approx(4.0) and mixing.bisect_repeats(10.0, 10.0, 2.0) == 0.0


def test_mixing_edges(spark):
    rows = [(1, None, "en", None, 0), (2, "", "en", "a", 0), (None, "x y", "en", "a", 3), (4, "x", "en", "b", 1), (4, "x", "en", "b", 1)]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("c") for c in ("n", "key", "copy", "t", "goal")})
    assert sum(r.copy == 0 for r in mixing.schedule(df).collect()) == 5
    out = mixing.mix(df)
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} == {1, 2, 4, None}
    empty = spark.createDataFrame([], DOCS)
    assert mixing.schedule(empty).collect() == [] and mixing.mix(empty).collect() == []


def brute_best_fit(lengths, size):
    rows, free = [], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [r for r in range(len(rows)) if free[r] >= lengths[i]]
        if fits:
            r = min(fits, key=lambda r: free[r])
        else:
            rows.append([])
            free.append(size)
            r = len(rows) - 1
        rows[r].append(i)
        free[r] -= lengths[i]
    return rows


def test_best_fit_decreasing():
    rng = random.Random(3)
    for _ in range(60):
        size = rng.randint(1, 40)
        lengths = [rng.randint(1, size) for _ in range(rng.randint(0, 60))]
        got = packing.best_fit_decreasing(lengths, size)
        assert sorted(i for r in got for i in r) == list(range(len(lengths)))
        fill = lambda rows: sorted(sum(lengths[i] for i in r) for r in rows)
        assert fill(got) == fill(brute_best_fit(lengths, size))


def test_encoder_equals_the_tokenizer():
    e, rng = packing.Encoder(), random.Random(4)
    texts = ["", "a", " a", "a ", "a  b", "a\n b", "it's we'll 12 ab12 !!", "x\ty\u00a0z", "é ß 日本", "a \u00a0b", "a\n\nb c\r\nd"]
    texts += ["".join(rng.choices("ab 1'.\n\té\u2003 ", k=rng.randint(0, 50))) for _ in range(400)]
    for t in texts:
        assert np.frombuffer(e(t), dtype="<u2").tolist() == e.plain.encode_ordinary(t), repr(t)


def test_packing_round_trip(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(["alpha", "beta,", "γ", "delta"], k=rng.randint(0, 300))), "en", "s", 1) for i in range(60)]
    rows += [(100, None, "en", "s", 0), (101, "", "en", "s", 0), (102, "long " * 5000, "en", "s", 0), (5, rows[5][1], "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("ids", "pack_id", "n_tokens")})
    packed = packing.pack(df, size=64, pool=4000)
    for r in packed.collect():
        ids, pos = np.frombuffer(r.ids, dtype="<u2"), np.frombuffer(r.position_ids, dtype="<u2")
        assert len(ids) == len(pos) == 64 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 64
        assert (ids[r.n_tokens :] == packing.END).all() and len(r.doc_ids) == len(r.doc_offsets) == len(r.cu_seqlens) - 1
        for s, e in zip(r.cu_seqlens, r.cu_seqlens[1:]):
            assert pos[s:e].tolist() == list(range(e - s))
    assert packed.select("pack_id").distinct().count() == packed.count()
    parts = defaultdict(list)
    for r in packing.unpack(packed).collect():
        parts[r.doc_id].append((r.offset, list(r.ids)))
    encode = packing.Encoder().plain.encode_ordinary
    for i, t, *_ in rows:
        want = encode(t or "") + [packing.END]
        if i == 5:
            assert sum(len(x) for _, x in parts[i]) == 2 * len(want)
        else:
            assert [x for _, p in sorted(parts[i]) for x in p] == want
    assert packing.pack(spark.createDataFrame([], DOCS)).collect() == []


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(0, 0.15, (400, 16)).astype(np.float32)
    v[50:90] = v[50]  # ties
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(1000, None), (1020, []), (1040, [1.0, None]), (1060, [float("nan")] * 16), (1080, [float("inf")] * 16), (None, [1.0] * 16), (1100, [0.5, 0.25]), (1101, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("score", "rank", "v", "rb")})
    for block in (4096, 64):
        w = topk.whole_vectors(df)
        got = defaultdict(list)
        for r in topk.search(w, w.where("vec_id % 20 = 0"), 20, block, 8 if block == 64 else 4096).collect():
            got[r.query_id].append((r.rank, r.vec_id, r.score))
        ints = np.floor(64 * v.astype(float)).astype(int)
        for q in range(0, 400, 20):
            score = ints @ ints[q]
            best = sorted((i for i in range(400) if i != q), key=lambda i: (-score[i], i))[:20]
            assert sorted(got[q]) == [(k + 1, i, score[i]) for k, i in enumerate(best)]
        assert got[1100] == [(1, 1101, 48 * 64)] and set(got) == {*range(0, 400, 20), 1100}
    assert topk.op8_topk(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_topk_of_large_numbers():
    v = np.array([[1 << 40, -(1 << 39)]] * 90 + [[1 << 41, 5]], dtype=np.int64)
    at, ids, scores = topk.ImpactIndex(np.arange(91), v).search(v[:1], np.array([0]), 3)
    assert ids.tolist() == [90, 1, 2] and scores[0] == (1 << 81) - 5 * (1 << 39)


HARD = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="no-sidebar"><div id="cookie-notice">We use cookies</div><header><h1>Site</h1></header><nav>Menu <a href="/x">x</a></nav>
<div class="sidebar">side</div><form action="/s">Search</form><article><h1>Title &amp; more</h1><p>One <b>bold</b> and <a href=x>link</a>&nbsp;end.<p>Two &lt;3<aside>aside</aside><script>if(a<b){"</p>"}</script>
<div class="ad-slot">buy</div><ul><li>first<li>second</ul><table><tr><td>c1<td>c2</table></article><section id="comments"><article class="comment">nice!</article></section><footer>foot</footer></body></html>"""


def test_html_of_one_page():
    assert html_extract.extract(HARD) == "Title & more One bold and link end. Two <3 first second c1 c2"
    assert html_extract.extract(None) == html_extract.extract("") == html_extract.extract("<article></article><p>x") == ""
    assert html_extract.extract("no tags & a < b") == "no tags & a < b"
    assert html_extract.extract('<form id="page"><div class="content"><p>kept</p></div></form>') == "kept"
    assert len(html_extract.extract("<p>" + "long text " * 50_000)) == 499_999


def test_html_containers_that_are_none_of_the_article():
    story = "<body><div>long story</div>"
    for rest in ("<aside><article>teaser</article></aside>", "<!-- <article> -->", "<script>'<main>'</script>", "<nav><main>x</main></nav>"):
        assert html_extract.extract(story + rest) == "long story"
    assert html_extract.extract(story + "<article><div class=ad>buy</div></article>") == ""


def test_html_wrapper_is_a_union_free_expression():
    page = lambda ps, note="": f"<body><nav><a>home</a><a>news</a></nav>{note}<main>{''.join(f'<p>{p}</p>' for p in ps)}</main></body>"
    w = html_extract.infer([page(["a", "b"]), page(["c", "d", "e"], "<div>note</div>"), page(["f", "g"])])
    assert html_extract.as_regex(w) == '<body><nav>(<a>#</a>)+</nav>(<div>"note"</div>)?<main>(<p>#</p>)+</main></body>'.replace('(<a>#</a>)+', "(<a>#</a>)+")


def test_html_template_texts_without_a_container(spark):
    pages = [(i, f"http://h.org/{i}", f"<body><div>Welcome</div><p>story {i}</p><p>All rights</p></body>") for i in range(8)]
    got = {r.page_id: r.text for r in html_extract.op10_html_extract(spark.createDataFrame(pages, PAGES)).collect()}
    assert got == {i: f"story {i}" for i in range(8)}


def test_html_template_of_all_pages_of_a_host(spark):
    """A notice inside the article goes though some pages lack it; a layout of few pages has constants of its own."""
    note = lambda i: "" if i % 7 == 3 else "<div class=hint>Join our list</div>"
    pages = [(i, f"http://h.org/{i}", f"<article><p>story {i}</p>{note(i)}<p>more {i % 9}</p></article>") for i in range(40)]
    pages += [(i, f"http://h.org/{i}", f"<main><p>talk {i}</p><div class=tail>Send a letter</div></main>") for i in range(40, 44)]
    pages += [(i, f"http://s.org/{i}", f"<body><p>shared by few</p><p>own {i}</p></body>" if i < 56 else f"<body><p>own {i}</p></body>") for i in range(50, 70)]
    got = {r.page_id: r.text for r in html_extract.op10_html_extract(spark.createDataFrame(pages, PAGES)).collect()}
    want = {i: f"story {i} more {i % 9}" for i in range(40)} | {i: f"talk {i}" for i in range(40, 44)}
    assert got == want | {i: f"shared by few own {i}" if i < 56 else f"own {i}" for i in range(50, 70)}


def test_html_own_container_of_a_page(spark):
    pages = [(i, f"http://h.org/{i}", f"<div class=content><p>text {i}</p></div>") for i in range(9)]
    pages += [(9, "http://h.org/9", "<div class=content><p>intro</p></div><article><p>story</p></article>")]
    got = {r.page_id: r.text for r in html_extract.op10_html_extract(spark.createDataFrame(pages, PAGES)).collect()}
    assert got[9] == "intro story" and got[3] == "text 3"


def test_html_rows(spark):
    rows = [(1, "http://a.org/1", HARD), (1, "http://a.org/1", HARD), (2, None, None), (3, "x", ""), (None, "http://b.org", "<p>b</p>")]
    df = spark.createDataFrame(rows, PAGES).withColumns({c: F.lit("x") for c in ("host", "text", "wrapper", "__host")})
    got = sorted((r.page_id or 0, r.url, r.text, r.n_chars) for r in html_extract.op10_html_extract(df).collect())
    assert len(got) == 5 and all(n == len(t) for *_, t, n in got)
    assert {t for i, _, t, _ in got if i in (2, 3)} == {""}
    assert html_extract.op10_html_extract(spark.createDataFrame([], PAGES)).collect() == []


def test_pipeline_on_a_fixture(spark, tmp_path):
    rng = random.Random(7)
    vocabulary = {"en": "the of and house water under garden with stone river".split(), "de": "und der haus wasser garten mit stein unter fluss das".split()}
    passage = "a passage of the benchmark that is long enough to be told from any chance meeting of letters in a text"
    prose = lambda lang, n=60: " ".join(rng.choice(vocabulary[lang]) for _ in range(n))
    rows = [(i, prose(lang), lang, "big" if i % 4 else "small", 1) for i, lang in enumerate(rng.choices(["en", "de"], k=80))]
    rows += [(200 + i, rows[3][1], "en", "big", 1) for i in range(5)] + [(300, prose("en") + " " + passage, "en", "big", 1), (301, "1234 5678", "en", "big", 1), (302, None, None, None, 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "token_packing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs
    ids = lambda n: {r.doc_id for r in seen[n].select("doc_id").collect()}
    assert ids("language_id") == {r[0] for r in rows} - {301, 302}
    assert ids("simhash_near_dedup") == ids("language_id") - {200, 201, 202, 203, 204}
    assert ids("benchmark_decontamination") == ids("simhash_near_dedup") - {300}
    assert ids("source_mixing") == ids("benchmark_decontamination")
    copies = Counter(r.doc_id for r in seen["source_mixing"].collect())
    packed = Counter((d, o) for r in seen["token_packing"].collect() for d, o in zip(r.doc_ids, r.doc_offsets))
    assert {d: n for (d, o), n in packed.items() if o == 0} == dict(copies)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen["token_packing"].count()
