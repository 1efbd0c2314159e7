"""Chapter search and chapter documents over the nested handbook."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import clean_texts, shape, title_similarity
from ..session import cut

LEAF_LEVEL = 4
#: Longest part of a title that the search index holds.
GRAM = 3


def chapters(books: DataFrame) -> DataFrame:
    """One row per chapter, in file order within its book."""
    sections = books.select(
        F.col("bookid").alias("bookId"), "bookTitle",
        F.posexplode("sections").alias("section_no", "section"))
    return sections.select(
        "bookId", "bookTitle", "section_no",
        F.col("section.chapterTitle").alias("sectionTitle"),
        F.col("section.chapterLevel").alias("sectionLevel"),
        F.posexplode("section.chapters").alias("chapter_no", "chapter")).select(
        "bookId", "bookTitle", "section_no", "sectionTitle", "sectionLevel", "chapter_no",
        "chapter.*")


def leaf_chapters(books: DataFrame, level: int = LEAF_LEVEL) -> DataFrame:
    return chapters(books).filter(F.col("chapterLevel") == level)


def _first_titled(books: DataFrame, title: Column) -> DataFrame:
    """The first book (lowest id) whose title contains ``title``, as its one id."""
    return books.filter(F.contains(F.lower("bookTitle"), F.lower(title))).agg(
        F.min("bookid").alias("bookid"))


def closest_book(books: DataFrame, target: str) -> DataFrame:
    """Title of the most similar book; equal scores go to the lower id."""
    titles = books.groupBy("bookTitle").agg(F.min("bookid").alias("bookid"))
    scored = titles.withColumn("score", title_similarity(F.col("bookTitle"), target))
    return scored.agg(F.min_by("bookTitle", F.struct(-F.col("score"), "bookid"))
                      .alias("bookTitle"))


def search(books: DataFrame, substring: str, book: str = "") -> DataFrame:
    """Leaf chapters whose title contains the text, in any case of letters."""
    space = books
    if book:
        best = closest_book(books, book).scalar()
        space = books.filter(F.col("bookid") == _first_titled(books, best).scalar())
    return leaf_chapters(space).filter(
        F.contains(F.lower("chapterTitle"), F.lower(F.lit(substring)))).select(
        "bookId", "bookTitle", "chapterId", "chapterTitle")


def _parts(text: Column, n: Column) -> Column:
    """All parts of ``text`` of ``n`` characters, or the text itself if it is shorter."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - n + 1))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, n)))


def title_hits(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, columns of ``rows``): chapters whose title contains a query, in any case.

    Titles are indexed by their parts of up to ``GRAM`` characters.  A query is looked
    up by that one of its parts that the fewest titles hold, and what it meets there is
    confirmed.  A query with a part that no title holds meets nothing; an empty one is
    in every title, a null one in none.
    """
    every = [_parts(F.col("_title"), F.lit(n)) for n in range(1, GRAM + 1)]
    postings = rows.filter(F.col("chapterTitle").isNotNull()).withColumn(
        "_title", F.lower("chapterTitle")).withColumn(
        "_gram", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), *every))))
    longest = _parts(F.col("_text"), F.least(F.lit(GRAM), F.length("_text")))
    parts = queries.select("query").filter("query is not null").distinct().withColumn(
        "_text", F.lower("query")).withColumn("_gram", F.explode(longest))
    held = postings.select("_gram").join(parts.hint("merge"), "_gram", "left_semi").groupBy("_gram").agg(
        F.count(F.lit(1)).alias("n"))
    rarest = parts.join(held, "_gram", "left").groupBy("query", "_text").agg(
        F.min_by("_gram", F.struct(F.coalesce("n", F.lit(0)), "_gram")).alias("_gram"))
    # A written table's size says nothing of its parts, so neither side may be taken for small.
    return postings.join(rarest.hint("merge"), "_gram").filter(F.contains("_title", F.col("_text"))).select(
        "query", *rows.columns)


def route(books: DataFrame, queries: list[str] | DataFrame) -> DataFrame:
    """What a search for each text leads to: nothing, one chapter, or a list.

    ``queries`` is a table with a column ``query``, or a few texts.  Queries, titles
    and hits are read several times and so written once: books are long rows.
    """
    if not isinstance(queries, DataFrame):
        queries = books.sparkSession.createDataFrame([(q,) for q in queries], "query string")
    asked = cut(queries.select("query").filter("query is not null").distinct())
    titles = cut(leaf_chapters(books).select("bookId", "chapterId", "chapterTitle"))
    # Written titles lie in a few small files; they are taken apart in as many tasks as a shuffle has.
    tasks = int(books.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hits = cut(title_hits(titles.repartition(tasks), asked))
    counts = hits.groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    status = F.when(n == 0, "not found").when(n == 1, "chapter").otherwise("list")
    return asked.join(counts, "query", "left").select(
        "query", n.alias("n"), status.alias("status")).join(hits, "query", "left")


def describe(books: DataFrame, queries: list[str] | DataFrame, clean: bool = False) -> DataFrame:
    """``route``, with the document of the chapter where a search leads to just one.

    ``content`` and ``attachments`` are null for the entries of lists, and for
    chapters that have no document because their section is not of level 1.
    """
    found = route(books, queries)
    only = found.filter(F.col("status") == "chapter").select("bookId", "chapterId").distinct()
    rows = leaf_chapters(books).filter(F.col("sectionLevel") == 1).join(
        only, ["bookId", "chapterId"], "left_semi")
    first = rows.groupBy("bookId", "chapterId").agg(F.min_by(
        F.struct(*rows.columns), F.struct("section_no", "chapter_no")).alias("r")).select("r.*")
    texts = documents(first, clean).select(
        "bookId", "chapterId", F.lit("chapter").alias("status"), "content", "attachments")
    return found.join(texts, ["bookId", "chapterId", "status"], "left")


def chapter_documents(books: DataFrame, clean: bool = False) -> DataFrame:
    """Every leaf chapter of the level-1 sections as one document.

    ``content`` maps each heading to a list: the joined contributions, or with
    ``clean`` their shaped parts.  A heading that repeats keeps its last text.
    Nothing is regrouped: a chapter is worked on inside its own row.
    """
    return documents(leaf_chapters(books).filter(F.col("sectionLevel") == 1), clean)


def documents(rows: DataFrame, clean: bool = False) -> DataFrame:
    last = F.filter(
        "content", lambda c, i: ~F.exists(
            F.slice("content", i + 2, F.size("content")),
            lambda d: d["headingTitle"] == c["headingTitle"]))
    rows = rows.withColumn("_c", last).withColumn("_keys", F.col("_c.headingTitle")).withColumn(
        "_texts", F.transform("_c", lambda c: F.array_join(c["contributions"]["headingText"], "")))
    if clean:
        rows = rows.withColumn("_texts", clean_texts(F.col("_texts")))
        values = F.zip_with("_keys", "_texts", lambda k, t: shape(k, t))
    else:
        values = F.transform("_texts", lambda t: F.array(t))
    kind = lambda a: a["type"]
    attachments = F.transform("attachment", lambda a: F.struct(
        F.when(kind(a) == "Figure", a["legend"])
         .when(kind(a) == "Table", F.regexp_replace(a["title"], r"<[^\n]*?>", ""))
         .otherwise("").alias("title"),
        kind(a).alias("type"),
        F.when(kind(a) == "Figure", a["imageUrl"]).when(kind(a) == "Table", a["tablehtml"])
         .otherwise("").alias("content")))
    return rows.select("bookId", "bookTitle", "sectionTitle", "section_no", "chapter_no",
                       "chapterId", "chapterTitle",
                       F.map_from_arrays("_keys", values).alias("content"),
                       attachments.alias("attachments"))


def get_chapter(books: DataFrame, book_id=None, chapter_id=None, book_title=None,
                chapter_title=None, clean: bool = False) -> DataFrame:
    """One chapter's document, by both ids, or by part of the book's title and the
    exact title of a chapter of any level.  The first match in file order."""
    if book_id is not None and chapter_id is not None:
        rows = leaf_chapters(books.filter(F.col("bookid") == book_id)).filter(
            F.col("chapterId") == chapter_id)
    else:
        wanted = _first_titled(books, F.lit(book_title)).scalar()
        rows = chapters(books.filter(F.col("bookid") == wanted)).filter(
            F.col("chapterTitle") == chapter_title)
    rows = rows.filter(F.col("sectionLevel") == 1)
    first = F.min_by(F.struct(*rows.columns), F.struct("section_no", "chapter_no"))
    return documents(rows.groupBy().agg(first.alias("r")).filter("r is not null").select("r.*"),
                     clean)


def book_list(books: DataFrame) -> DataFrame:
    return books.select(F.col("bookid").alias("bookId"), "bookTitle")


def get_book(books: DataFrame, book_id=None, title: str | None = None) -> DataFrame:
    """One book with all its cleaned leaf chapters, one row per chapter."""
    wanted = F.lit(book_id) if title is None else _first_titled(books, F.lit(title)).scalar()
    one = books.filter(F.col("bookid") == wanted)
    parts = documents(leaf_chapters(one), clean=True)
    about = one.select(F.col("bookid").alias("bookId"), "series", "revision")
    return about.join(parts, "bookId").select(
        "bookId", "bookTitle", "series", "revision", "sectionTitle", "chapterId",
        "chapterTitle", "content")
