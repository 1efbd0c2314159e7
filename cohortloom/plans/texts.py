"""Registered queries: handbook search and chapter documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import handbook as hb
from . import standins as st
from .registry import Query

TOPICS = ["That the", "ERSTHER", "example.com", "handbuch", "zzz"]


def chapter_list(spark, d):
    return hb.leaf_chapters(st.books(spark, d)).select(
        "bookId", "bookTitle", "chapterId", "chapterTitle")


def chapter_search(spark, d):
    return hb.search(st.books(spark, d), "THE ")


def book_search(spark, d):
    return hb.search(st.books(spark, d), "e", book="The theand thereing of the ontion")


def book_similarity(spark, d):
    return hb.book_list(st.books(spark, d)).withColumn(
        "score", tx.title_similarity(F.col("bookTitle"), "The theand thereing of the ontion"))


def clean_text(spark, d):
    return st.table(spark, d, "pages").select("page_id", tx.clean_text("html").alias("text"))


def paragraph_rows(spark, d):
    return st.table(spark, d, "pages").select(
        "page_id", F.posexplode(tx.paragraphs(F.col("html"))).alias("no", "paragraph"))


def chapter_docs(spark, d):
    docs = hb.chapter_documents(st.books(spark, d))
    return docs.select("bookId", "chapterId", F.explode("content").alias("heading", "parts")).select(
        "bookId", "chapterId", "heading", F.array_join("parts", "|").alias("text"))


def chapter_attachments(spark, d):
    docs = hb.chapter_documents(st.books(spark, d))
    return docs.select("bookId", "chapterId", F.inline("attachments"))


def chapter_docs_clean(spark, d):
    docs = hb.chapter_documents(st.books(spark, d), clean=True)
    return docs.select("bookId", "chapterId", F.explode("content").alias("heading", "parts")).select(
        "bookId", "chapterId", "heading", F.posexplode("parts").alias("no", "part"))


def book_list(spark, d):
    return hb.book_list(st.books(spark, d))


def full_book(spark, d):
    """The first book whose title holds the text, with its cleaned chapters."""
    rows = hb.get_book(st.books(spark, d), title="the")
    return rows.select("bookId", "series", "chapterId", F.explode("content").alias("heading", "parts")) \
        .select("bookId", "series", "chapterId", "heading", F.posexplode("parts").alias("no", "part"))


def chapter_by_id(spark, d):
    """One chapter by its book's id and its own."""
    one = hb.get_chapter(st.books(spark, d), book_id=7, chapter_id=71, clean=True)
    return one.select("bookId", "chapterId", F.explode("content").alias("heading", "parts")).select(
        "bookId", "chapterId", "heading", F.posexplode("parts").alias("no", "part"))


def search_route(spark, d):
    return hb.route(st.books(spark, d), TOPICS)


def _words(spark, d):
    """Every word of a chapter title, a text that somebody may search for."""
    return hb.leaf_chapters(st.books(spark, d)).select(
        F.explode(F.split("chapterTitle", " ")).alias("query")).distinct()


def word_routes(spark, d):
    """All words of all chapter titles, searched for at once."""
    return hb.route(st.books(spark, d), _words(spark, d)).groupBy("query", "n", "status").agg(
        F.min("chapterId").alias("first"), F.max("chapterId").alias("last"))


def described(spark, d):
    """The documents that titles lead to which are in one chapter only."""
    titles = hb.leaf_chapters(st.books(spark, d)).select(F.col("chapterTitle").alias("query"))
    found = hb.describe(st.books(spark, d), titles).filter("status = 'chapter'")
    return found.select("query", "bookId", "chapterId", F.explode("content").alias("heading", "parts")) \
        .select("query", "bookId", "chapterId", "heading", F.array_join("parts", "|").alias("text"))


_TOPICS = "[" + ", ".join(f"'{t}'" for t in TOPICS) + "]"
_DOCS = f"""
  SELECT "bookId", "chapterId", 'Definition' AS heading,
         regexp_extract(html, '{st._PARA}', 1) AS text FROM x WHERE "chapterId" % 10 = 1
  UNION ALL SELECT "bookId", "chapterId", 'Histopathology', html FROM x WHERE "chapterId" % 10 = 1
  UNION ALL SELECT "bookId", "chapterId", 'Subtype(s)', regexp_extract(html, '{st._TITLE}', 1)
    || '; ' || regexp_extract(html, '{st._FOOT}', 1) FROM x WHERE "chapterId" % 10 = 1
  UNION ALL SELECT "bookId", "chapterId", 'Staging', html FROM x WHERE "chapterId" % 10 = 2"""


def _clean_sql(t: str) -> str:
    """The cleaning order, with the entities the pages use; the ampersand last."""
    for a, b in (("&nbsp;", " "), ("<sup>", "^"), ("</sup>", "")):
        t = f"replace({t}, '{a}', '{b}')"
    t = f"replace(replace(replace({t}, chr(10), ' '), chr(13), ' '), chr(92) || 'u2013', '-')"
    t = f"trim({t})"
    for a, b in (("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&lt;", "<"),
                 ("&gt;", ">"), ("&amp;", "&")):
        t = f"replace({t}, '{a}', '{b}')"
    return f"regexp_replace(regexp_replace({t}, ' +', ' ', 'g'), '<a[^\\n]*?a>', '', 'g')"


_BARE = "regexp_replace(t, '</?[emp]+ ?>', '', 'g')"
_SHAPED = f"""
  SELECT "bookId", "chapterId", heading, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS no,
         unnest(parts) AS part
  FROM (SELECT "bookId", "chapterId", heading, CASE heading
          WHEN 'Definition' THEN [{_BARE}]
          WHEN 'Subtype(s)' THEN CASE WHEN contains({_BARE}, 'None') THEN []
            ELSE string_split({_BARE}, '; ') END
          ELSE list_transform(regexp_extract_all(t, '{st._PARA}', 1),
                 lambda p: regexp_replace(p, '</?em ?>', '', 'g')) END AS parts
        FROM (SELECT "bookId", "chapterId", heading, {_clean_sql("text")} AS t FROM ({_DOCS})))"""
_PAGES = f"""x AS (SELECT l.*, html FROM ({st.LEAVES}) l JOIN pages ON page_id = "bookId")"""

QUERIES = {
    "chapter_list": Query(chapter_list, st.LEAVES),
    "chapter_search": Query(
        chapter_search,
        f"""SELECT * FROM ({st.LEAVES}) WHERE contains(lower("chapterTitle"), 'the ')"""),
    "book_search": Query(book_search),
    "book_similarity": Query(book_similarity),
    "clean_text": Query(clean_text, f"SELECT page_id, {_clean_sql('html')} AS text FROM pages"),
    "paragraphs": Query(
        paragraph_rows,
        f"""SELECT page_id, CAST(no - 1 AS INTEGER) AS no,
              regexp_replace(paragraph, '</?em ?>', '', 'g') AS paragraph
            FROM (SELECT page_id, unnest(ps) AS paragraph, generate_subscripts(ps, 1) AS no
                  FROM (SELECT page_id, regexp_extract_all(html, '{st._PARA}', 1) AS ps
                        FROM pages))"""),
    "chapter_docs": Query(
        chapter_docs,
        f"""WITH x AS (SELECT l.*, html FROM ({st.LEAVES}) l JOIN pages ON page_id = "bookId")
            {_DOCS}"""),
    "chapter_attachments": Query(
        chapter_attachments,
        f"""SELECT l."bookId", l."chapterId", l."bookTitle" AS title, 'Figure' AS type,
              url AS content FROM ({st.LEAVES}) l JOIN pages ON page_id = l."bookId"
            UNION ALL
            SELECT l."bookId", l."chapterId", regexp_replace(l."bookTitle", '<[^\\n]*?>', '', 'g'),
              'Table', regexp_extract(html, '{st._PARA}', 1)
            FROM ({st.LEAVES}) l JOIN pages ON page_id = l."bookId" """),
    "chapter_docs_clean": Query(chapter_docs_clean, f"WITH {_PAGES} {_SHAPED}"),
    "chapter_by_id": Query(
        chapter_by_id, f"""WITH {_PAGES} SELECT * FROM ({_SHAPED}) WHERE "chapterId" = 71"""),
    "book_list": Query(
        book_list,
        f"""SELECT page_id AS "bookId", regexp_extract(html, '{st._TITLE}', 1) AS "bookTitle"
            FROM pages"""),
    "full_book": Query(
        full_book,
        f"""WITH {_PAGES}, book AS (
              SELECT page_id, regexp_extract(html, 'lang="([a-z]+)"', 1) AS series FROM pages
              WHERE contains(lower(regexp_extract(html, '{st._TITLE}', 1)), 'the')
              ORDER BY page_id LIMIT 1)
            SELECT s.*, series FROM ({_SHAPED}) s JOIN book ON page_id = "bookId" """),
    "search_words": Query(
        word_routes,
        f"""WITH l AS ({st.LEAVES}),
              q AS (SELECT DISTINCT unnest(string_split("chapterTitle", ' ')) AS query FROM l)
            SELECT query, count(*) AS n, CASE WHEN count(*) = 1 THEN 'chapter' ELSE 'list' END
              AS status, min("chapterId") AS first, max("chapterId") AS last
            FROM q JOIN l ON contains(lower("chapterTitle"), lower(query)) GROUP BY 1"""),
    "search_documents": Query(
        described,
        f"""WITH l AS ({st.LEAVES}), q AS (SELECT DISTINCT "chapterTitle" AS query FROM l),
              one AS (SELECT query, min("chapterId") AS id FROM q
                      JOIN l ON contains(lower("chapterTitle"), lower(query))
                      GROUP BY 1 HAVING count(*) = 1),
              x AS (SELECT l.*, html FROM l JOIN pages ON page_id = "bookId")
            SELECT query, d.* FROM one JOIN ({_DOCS}) d ON d."chapterId" = id"""),
    "search_route": Query(
        search_route,
        f"""WITH q AS (SELECT unnest({_TOPICS}) AS query),
              hits AS (SELECT query, "bookId", "chapterId", "chapterTitle"
                       FROM q JOIN ({st.LEAVES}) ON contains(lower("chapterTitle"), lower(query))),
              n AS (SELECT query, count(*) AS n FROM hits GROUP BY 1)
            SELECT q.query, coalesce(n, 0) AS n,
              CASE WHEN n IS NULL THEN 'not found' WHEN n = 1 THEN 'chapter' ELSE 'list' END
                AS status, "bookId", "chapterId", "chapterTitle"
            FROM q LEFT JOIN n ON n.query = q.query LEFT JOIN hits ON hits.query = q.query"""),
}
