"""Wrappers: what they are made of, that they decide, and pages that are hard to read."""

import random

import pytest

from subsida.llm import html_extract as h

PAGES = "page_id long, url string, html string"


def run(spark, pages):
    df = spark.createDataFrame([(i, f"http://{host}/{i}", page) for i, (host, page) in enumerate(pages)], PAGES)
    return {r.page_id: r.text for r in h.op10_html_extract(df).collect()}


def prose(rng, n=30):
    return " ".join("".join(rng.choices("aeioustrnl", k=rng.randint(2, 8))) for _ in range(n))


def site(rng, k):
    """A page whose parts have no telling names, and its article by hand."""
    title, paragraphs = prose(rng, 5), [prose(rng) for _ in range(rng.randint(2, 6))]
    side = "".join(f"<div class=k3>{prose(rng, 3)}</div>" for _ in range(rng.randint(1, 4)))
    body = "".join(f"<p>{p}</p>" + (f"<h2>{p[:9].strip()}</h2>" if rng.random() < 0.3 else "") for p in paragraphs)
    text = " ".join([title] + [x for p in body.split("<p>")[1:] for x in p.replace("</p>", "\n").replace("<h2>", "").replace("</h2>", "").split("\n") if x])
    note = "<div class=k9>Read our new book now</div>" if k % 6 else ""
    page = f"<html><body><div class=k1>Daily {k % 3}</div><div class=k2>{side}</div><div class=k4><h1>{title}</h1>{note}{body}<div class=k5>Tell your friends</div></div><div class=k6>All of it {k % 2}</div></body></html>"
    return page, text


def test_every_host_has_an_inferred_wrapper_and_it_decides(spark):
    rng = random.Random(1)
    pages, want = [], {}
    for k in range(60):
        page, text = site(rng, k)
        want[len(pages)] = text
        pages.append((f"h{k % 3}.org", page))
    got = run(spark, pages)
    assert got == want
    assert all(h.extract(page) != want[i] for i, (_, page) in enumerate(pages))  # without a wrapper the template's parts stay
    df = spark.createDataFrame([(i, f"http://{host}/{i}", page) for i, (host, page) in enumerate(pages)], PAGES)
    wrappers = {r.host: r for r in h.wrappers_of(df).collect()}
    assert set(wrappers) == {"h0.org", "h1.org", "h2.org"}
    assert all("k4" in r.wrapper and r.constants and r.nodes for r in wrappers.values())


def test_wrappers_depend_on_the_pages_alone(spark, monkeypatch):
    rng = random.Random(2)
    pages = [("h.org", site(rng, k)[0]) for k in range(80)]
    make = lambda rows: spark.createDataFrame([(i, f"http://{host}/", page) for i, (host, page) in enumerate(rows)], PAGES)
    table = lambda df: [tuple(r) for r in h.wrappers_of(df).collect()]
    one = table(make(pages).coalesce(1))
    assert one == table(make(pages[::-1] + pages[:7]).repartition(5))
    found = h.structures(make(pages)).groupBy("host", "sid").agg(h.F.first("structure").alias("structure"))
    several = h.infer_wrappers(found, fan=2).collect()  # many rounds
    assert len(several) == 1 and several[0].host == "h.org"


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article class='post sponsored-by'><p>words</p></article>", "words"),
        ("<article><p>one</p><section id='reply-to-critics'><p>two</p></section></article>", "one two"),
        ("<article><p>one</p><div class='ad-hoc'>two</div><div class='notice-of-law'>three</div></article>", "one two three"),
        ("<article><p>one</p><div class='ad'>buy</div><div id='cookie-notice'>x</div><div class='related-posts'>y</div></article>", "one"),
        ("<article><p>a<!-- x --!> b</p><p>c</p></article>", "a b c"),
        ("<article><p>a<!--> b</p><!---><p>c</p></article>", "a b c"),
        ("<div class=post-body><p>a long story of many words</p></div><article>teaser</article>", "a long story of many words"),
        ("<p>x</p><!-- never closed <article>y</article>", "x"),
        ("<article>a &amp; b&#33; &notaname; &lt;p&gt;</article>", "a & b! ¬aname; <p>"),
        ("<article><p>one</p><script>var a='<p>no</p>'</script><style>p{}</style><textarea>t</textarea></article>", "one"),
        ("plain", "plain"),
        ("<article>  \n </article>", ""),
    ],
)
def test_single_pages(page, text):
    assert h.extract(page) == text


def test_two_pages_of_a_host(spark):
    page = lambda i: f"<body><div>Welcome to us</div><p>own story number {i} of many words</p><p>All rights</p></body>"
    copies = lambda i: f"<body><p>the very same story of many words</p><p>and its second part</p><p>{i}</p></body>"
    got = run(spark, [("h.org", page(1)), ("h.org", page(2)), ("c.org", copies(1)), ("c.org", copies(2)), ("one.org", page(3))])
    assert got[0] == "own story number 1 of many words" and got[1] == "own story number 2 of many words"
    assert got[2] == "the very same story of many words and its second part 1"  # copies of one another keep their text
    assert got[4] == "Welcome to us own story number 3 of many words All rights"


def test_repeated_groups_and_options():
    page = lambda n, extra="": f"<dl>{''.join(f'<dt>{i}</dt><dd>{i * i}</dd>' for i in range(n))}</dl>{extra}"
    assert h.as_regex(h.infer([page(3)])) == "<dl>(<dt>#</dt><dd>#</dd>)+</dl>"
    assert h.as_regex(h.infer([page(3), page(1, "<p>x</p>"), page(4, "<p>x</p>")])) == '<dl>(<dt>#</dt><dd>#</dd>)+</dl>(<p>"x"</p>)?'
    assert h.as_regex(h.infer(["<div class='post post-17 tag-a'>x</div>", "<div class='post post-19 tag-b'>y</div>"])) == "<div.post.post-#>#</div>"
    assert h.as_regex(h.infer([])) == ""


def test_matching_places_every_text_of_the_pages_it_was_made_from():
    rng = random.Random(3)
    pages = [site(rng, k)[0] for k in range(40)]
    wrapper = h.infer(pages)
    for page in pages:
        own = h.structure(h.Page(page))
        texts = [n for n, node in enumerate(own.walk()) if node.name == "#"]
        to = h.places(h.unpack(wrapper.pack()), h.unpack(own.pack()))
        assert all(n in to for n in texts)


def test_deep_and_wide_pages(spark):
    deep = "<div>" * 5000 + "deep words" + "</div>" * 5000
    names = ["p", "h2", "h3", "ul", "blockquote", "h4", "pre"]
    rng = random.Random(4)
    wide = lambda: "".join(f"<{n}>{prose(rng, 2)}</{n}>" for n in rng.choices(names, k=400))
    pages = [("d.org", deep), ("d.org", deep + "<p>x</p>")] + [("w.org", wide()) for _ in range(6)]
    got = run(spark, pages)
    assert got[0] == "deep words" and got[1].startswith("deep words")
    for i in range(2, 8):
        assert got[i] == " ".join(h.Page(pages[i][1]).texts) and len(got[i]) > 1000
    wrapper = h.infer([p for _, p in pages[2:]])
    assert len(wrapper.kids) <= h.WIDTH and wrapper.loose


def test_urls_without_a_host_are_read_alone(spark):
    rows = [(1, None, "<p>same</p><p>a</p>"), (2, "no host", "<p>same</p><p>b</p>"), (3, "http:///x", "<p>same</p><p>c</p>")]
    got = {r.page_id: r.text for r in h.op10_html_extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {1: "same a", 2: "same b", 3: "same c"}
