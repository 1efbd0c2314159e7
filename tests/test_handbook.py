import html
import re

import pytest
from pyspark.sql import functions as F

from cohortloom import schemas
from cohortloom.functions import text as tx
from cohortloom.operators import handbook as hb


def content(**headings):
    return [(h.replace("_", " "), [(t,) for t in texts]) for h, texts in headings.items()]


@pytest.fixture(scope="module")
def books(spark):
    figure = ("Figure", "a figure", "http://img", "", "")
    table = ("Table", "", "", "<b>Tab</b> 1", "<table/>")
    other = ("Video", "x", "y", "z", "w")
    glioma = (94, "Ganglioglioma", 4, content(
        Definition=["<p>A <em>rare</em>", "&nbsp;tumour.</p>"],
        Histopathology=["<p>One &amp; <em>two</em></p>\n<p>three<a href='x'>b</a></p>"],
    ) + [("Subtype(s)", [("<p>Alpha; Beta</p>",)]), ("Definition", [("<p>Last</p>",)])],
        [figure, table, other])
    none = (95, "Diffuse glioma", 4, [("Subtype(s)", [("None",)])], [])
    group = (96, "Gliomas", 3, [], [])
    return spark.createDataFrame([
        (44, "Paediatric Tumours", "5th", "r1",
         [("Brain", 1, [glioma, none, group]), ("Annex", 2, [(97, "Glioma annex", 4, [], [])])]),
        (45, "Tumours of the Eye", "5th", "r2", [("Eye", 1, [(1, "Retinoblastoma", 4, [], [])])]),
    ], schemas.schema(schemas.BOOKS))


def test_search(books, rows):
    assert {r.chapterId for r in hb.search(books, "GLIOMA").collect()} == {94, 95, 97}
    assert {r.chapterId for r in hb.search(books, "blastoma", "tumour of eye").collect()} == {1}
    assert hb.search(books, "blastoma", "Paediatric").count() == 0
    assert rows(hb.book_list(books)) == [(44, "Paediatric Tumours"), (45, "Tumours of the Eye")]


def test_documents(books):
    doc = hb.get_chapter(books, book_id=44, chapter_id=94).first()
    assert doc.content["Definition"] == ["<p>Last</p>"]
    assert [tuple(a) for a in doc.attachments] == [
        ("a figure", "Figure", "http://img"), ("Tab 1", "Table", "<table/>"), ("", "Video", "")]
    clean = hb.get_chapter(books, book_title="paediatric", chapter_title="Ganglioglioma",
                           clean=True).first().content
    assert clean == {"Definition": ["Last"], "Subtype(s)": ["Alpha", "Beta"],
                     "Histopathology": ["One & two", "three"]}
    by_level = hb.get_chapter(books, book_title="paediatric", chapter_title="Gliomas")
    assert by_level.first().chapterId == 96
    # Only the sections of level 1 hold documents.
    assert hb.get_chapter(books, book_id=44, chapter_id=97).count() == 0
    assert {r.chapterId for r in hb.chapter_documents(books).collect()} == {94, 95, 1}


def test_whole_book(books):
    got = {r.chapterId: r.content for r in hb.get_book(books, title="PAEDIATRIC").collect()}
    assert set(got) == {94, 95, 97} and got[95] == {"Subtype(s)": []}
    assert hb.get_book(books, book_id=45).count() == 1


def test_routes(books):
    got = hb.route(books, ["retino", "glioma", "nothing"]).collect()
    assert {(r["query"], r.status, r.n) for r in got} == {
        ("retino", "chapter", 1), ("glioma", "list", 3), ("nothing", "not found", 0)}
    assert sum(r["query"] == "glioma" for r in got) == 3


def test_routes_of_a_table(books, frame):
    """Short, empty, null, repeated and unknown texts, against plain search."""
    titles = {94: "Ganglioglioma", 95: "Diffuse glioma", 97: "Glioma annex", 1: "Retinoblastoma"}
    asked = ["", "g", "GL", "oma", "a", " ", "diffuse glioma x", "annex", "annex", None, "ü", "Zz"]
    got = hb.route(books, frame([(q,) for q in asked], "query string")).collect()
    for q in {q for q in asked if q is not None}:
        want = {c for c, t in titles.items() if q.lower() in t.lower()}
        mine = [r for r in got if r["query"] == q]
        assert {r.chapterId for r in mine if r.chapterId is not None} == want
        assert len(mine) == max(1, len(want)) and {r.n for r in mine} == {len(want)}
    assert not any(r["query"] is None for r in got)
    assert hb.route(books, frame([], "query string")).count() == 0
    assert hb.route(books.limit(0), ["glioma"]).first().status == "not found"


def test_one_hit_returns_its_chapter(books):
    got = {r["query"]: r for r in hb.describe(books, ["ganglio", "annex", "zz"], clean=True).collect()}
    assert got["ganglio"].status == "chapter"
    assert got["ganglio"].content["Subtype(s)"] == ["Alpha", "Beta"]
    assert [a.title for a in got["ganglio"].attachments] == ["a figure", "Tab 1", ""]
    # Its section is of level 2, so there is no document.
    assert got["annex"].status == "chapter" and got["annex"].content is None
    assert got["zz"].status == "not found" and got["zz"].content is None
    lists = hb.describe(books, ["glioma"]).collect()
    assert len(lists) == 3 and all(r.content is None for r in lists)


TEXTS = ["  a&nbsp;b\n\nc\r ", "x<sup>2</sup> \\u2013 y", "&lt;a href&gt; k &amp;amp; <a b>q</a>z",
         "&eacute;&#233;&#xe9; &notit; &copy 1", "", "<a\n>x</a>", "a   b"]


@pytest.mark.parametrize("text", TEXTS)
def test_cleaning_order(spark, text):
    want = text
    for old, new in (("&nbsp;", " "), ("\n", " "), ("\r", " "), ("\\u2013", "-"),
                     ("<sup>", "^"), ("</sup>", "")):
        want = want.replace(old, new)
    want = re.sub(r"<a.*?a>", "", re.sub(" +", " ", html.unescape(want.strip())))
    got = spark.createDataFrame([(text,)], "t string").select(tx.clean_text("t").alias("r"))
    assert got.first().r == want


def common(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_similarity(spark):
    titles = ["Paediatric Tumours", "", "Tumours", "zzz", "ruomuT", "Tumours of the Eye" * 9]
    target = "Tumour of eye"
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    got = {r.t: r.s for r in df.withColumn("s", tx.title_similarity(F.col("t"), target)).collect()}
    for t in titles:
        assert got[t] == round(200 * common(t, target) / (len(t) + len(target)))


def test_routes_read_written_hits(books):
    """Books are long rows: titles, queries and hits are not made again for each use."""
    plan = hb.route(books, ["retino", "glioma"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Relation" in plan
