"""Cuts are minimal; articles come whole and boilerplate goes."""

import html as entities
import random
import re
from itertools import product

import numpy as np

from cohortloom.llm import extract as x

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head>
<body class="post"><header><p>Site name</p></header><nav><ul><li><a href="/">Home</a><li><a href="/b">News, views</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, as all do.</p></div><!-- <p>not shown</p> -->
<aside><p>Other stories, many of them.</p></aside>
<article><header><h1>A &amp; B</h1></header><p>First  <b>para</b>graph, with&nbsp;words.<br>Second line.
<p>Second one; it has &quot;quotes&quot;, and an end.</p><div class="ad">Buy this, now.</div><p>Ok.</p>
<form><p>Write to us, please.</p><textarea>x</textarea></form>
<section id="comments"><p>I disagree, strongly, with all of it.</p></section></article>
<footer>&copy; 2024 Someone.</footer></body></html>"""
WANT = 'A & B\n\nFirst paragraph, with words. Second line.\n\n' \
       'Second one; it has "quotes", and an end.\n\nOk.'


def text(html, weights=x.UNTAUGHT):
    return "\n\n".join(b.text for b in x.content(x.blocks(html), weights))


def test_a_page():
    assert text(PAGE) == WANT


def test_without_telling_markup():
    bare = re.sub(r"<(/?)(article|nav|aside|footer|header|form|section)\b", r"<\1div",
                  re.sub(r' (class|id)="[^"]*"', "", PAGE))
    got = text(bare)
    assert "First paragraph" in got and "Second one" in got and "Home" not in got


def test_cut_is_least():
    """Against every labelling of small random networks."""
    rnd = random.Random(9)
    for _ in range(150):
        n = rnd.randint(1, 8)
        odds = [rnd.uniform(-3, 3) for _ in range(n)]
        ties = [(*sorted(rnd.sample(range(n), 2)), rnd.uniform(0, 2)) for _ in range(rnd.randint(0, 10)) if n > 1]
        net = x.Network(odds)
        for a, b, tie in ties:
            net.add(a, b, tie, tie)
        level = net.cut()
        cost = lambda side: sum(-o if s else 0 for o, s in zip(odds, side)) + sum(
            t for a, b, t in ties if side[a] != side[b])
        best = min(cost(side) for side in product((False, True), repeat=n))
        assert abs(cost([level[i] >= 0 for i in range(n)]) - best) < 1e-9


def test_broken_markup():
    for html in ("", "<", "a < b", "<p>one<p>two", "<a " * 30_000, "<!--" * 30_000, "<p class='" * 30_000,
                 "<script>" * 30_000, "</p>" * 100, "<div>" * 30_000 + "x", "<li><li><li>x", "plain text, only."):
        text(html)
    assert [b.text for b in x.blocks("<p>one<p>two<br>three &lt;b&gt;")] == ["one", "two three <b>"]


def test_rows(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = {r.page_id: r for r in x.main_text(pages).collect()}
    for page in pages.collect():
        article = re.search(r"<article>(.*?)</article>", page.html, re.S).group(1)
        parts = (" ".join(entities.unescape(re.sub("<[^>]*>", " ", p)).split())
                 for p in re.split(r"</?(?:p|h1)>", article))
        want = "\n\n".join(p for p in parts if p)
        assert (rows[page.page_id].text, rows[page.page_id].n_chars) == (want, len(want))
        assert rows[page.page_id].url == page.url


def test_odd_rows(spark):
    odd = [(1, "u", None, "c"), (1, "u", None, "c"), (None, None, "", "c"), (2, "v", PAGE, "c"),
           (3, "w", "<p>" + "long words, here. " * 50_000 + "</p>", "c"), (4, "x", "<nav>menu</nav>", "c")]
    schema = "page_id long, url string, html string, text string"
    got = sorted((tuple(r) for r in x.main_text(spark.createDataFrame(odd, schema)).collect()), key=repr)
    assert [r[:2] + (len(r[2]) == r[3],) for r in got] == sorted(
        [(1, "u", True), (1, "u", True), (2, "v", True), (3, "w", True), (4, "x", True), (None, None, True)], key=repr)
    assert {r[0]: r[2] for r in got}[2] == WANT and {r[0]: r[2] for r in got}[4] == ""
    assert x.main_text(spark.createDataFrame([], schema)).count() == 0


def test_fit_separates():
    rnd = np.random.default_rng(3)
    a = np.zeros((200, len(x.UNTAUGHT)))
    a[:, 0], a[:, 1] = 1, rnd.random(200)
    y = (a[:, 1] < 0.5).astype(float)
    w = x.fit(a, y)
    assert (((a @ w) > 0) == (y > 0)).mean() > 0.95


def test_words_of_the_whole_page_blank_nothing():
    story = "<h1>A title</h1><p>First one, with words, and an end.</p><p>Second one, with more, and an end.</p>"
    for page in ("<body class='no-sidebar'>%s</body>", "<body class='single comments-open search-results'>%s</body>",
                 "<html class='cookie-banner'><body>%s</body></html>", "<main id='skip-menu'>%s</main>",
                 "<article class='post comments-open has-related'>%s</article>"):
        got = text(page % story)
        assert "First one" in got and "Second one" in got, page
    assert text("<body class='no-sidebar'><div class='sidebar'><p>Buy this, now.</p></div></body>") == ""


def test_closed_drawings_and_formulas():
    def texts(html):
        return [b.text for b in x.blocks(html)]

    assert texts('<p>one</p><svg class="i"/><p>two</p>') == ["one", "two"]
    assert texts('<p>one</p><svg alt="a > b" /><p>two</p>') == ["one", "two"]
    assert texts("<p>one</p><svg><text>no</text></svg><p>two</p>") == ["one", "two"]
    assert texts("<p>As <math><msup><mi>x</mi><mn>2</mn></msup><mo>=</mo><mi>y</mi>"
                 "<annotation encoding='tex'>x^2</annotation></math> says.</p>") == ["As x2=y says."]
    assert texts("<p>one<math/> two</p>") == ["one two"]


def test_names_of_subjects_blank_no_article(spark):
    """Class words that are part of a subject's name leave the text to the text itself."""
    long = ["The river rises in the northern hills and runs past the old town, where the first bridge "
            f"was built in the year {1700 + n}, before it turns to the sea through wide and open fields." for n in range(3)]
    body = "".join(f"<p>{p}</p>" for p in long)
    pages = ["<div class='form-of-government'>%s</div>", "<div id='social-history'>%s</div>",
             "<div class='search-article'>%s</div>", "<main><section class='legal'>%s</section></main>",
             "<article><p>First of all.</p><section id='related-work'>%s</section></article>"]
    bad = ["<div class='site-footer'>%s</div>", "<div class='comment-list'>%s</div>", "<div class='ad-slot'>%s</div>"]
    rows = [(n, "u", f"<html><body>{p % body}</body></html>") for n, p in enumerate(pages)]
    rows += [(100 + n, "u", f"<html><body><article>{body}</article>{p % '<p>Some other words that stand here.</p>'}</body></html>")
             for n, p in enumerate(bad)]
    # Real pages teach the classifier what text looks like.
    taught = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").selectExpr("page_id + 1000 AS page_id", "url", "html")
    got = {r.page_id: r.text for r in x.main_text(
        spark.createDataFrame(rows, "page_id long, url string, html string").unionByName(taught)).collect()}
    for n in range(len(pages)):
        assert all(p in got[n] for p in long), pages[n]
    for n in range(len(bad)):
        assert got[100 + n] == "\n\n".join(long), bad[n]


def test_learns_from_all_pages(spark):
    """The sums over all pages, in any number of parts, give what one fit over all their blocks gives."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    told = [x._told(r.html or "") for r in pages.select("html").collect()]
    want = x.fit(*(np.concatenate([t[i] for t in told]).astype(float) for i in (0, 1)))
    assert not np.allclose(want, x.UNTAUGHT, atol=0.1)
    for parts in (1, 7):
        assert np.allclose(x.learn(pages.repartition(parts)), want, atol=1e-5)
    assert (x.learn(pages.limit(0)) == x.UNTAUGHT).all()
    assert (x.learn(spark.createDataFrame([(None,), ("",), ("<p>untold</p>",)], "html string")) == x.UNTAUGHT).all()
