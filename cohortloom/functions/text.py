"""Cleaning and shaping of handbook text."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Headings by the shape of their text.
PLAIN_HEADINGS = ("Definition", "ICD-O coding", "ICD-11 coding", "Related terminology",
                  "Localization")
LIST_HEADING = "Subtype(s)"
PARAGRAPH_HEADINGS = ("Clinical features", "Epidemiology", "Etiology", "Pathogenesis",
                      "Macroscopic appearance", "Histopathology", "Cytology",
                      "Diagnostic molecular pathology", "Essential and desirable diagnostic criteria",
                      "Staging", "Prognosis and prediction")


def _unescape_all(texts: pd.Series) -> pd.Series:
    return texts.map(lambda some: None if some is None else [
        None if t is None else html.unescape(t) for t in some])


def _unescape(texts: Column) -> Column:
    """Entities to characters.  Marked so that the optimizer neither repeats the
    call nor moves it into a filter it infers from a later explode."""
    udf = F.pandas_udf(_unescape_all, T.ArrayType(T.StringType())).asNondeterministic()
    return udf(texts)


def clean_texts(texts: Column) -> Column:
    """Clean every string of an array column; only entities leave the JVM."""

    def before(t: Column) -> Column:
        for old, new in (("&nbsp;", " "), ("\n", " "), ("\r", " "), ("\\u2013", "-"),
                         ("<sup>", "^"), ("</sup>", "")):
            t = F.replace(t, F.lit(old), F.lit(new))
        return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")

    def after(t: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(t, " +", " "), r"<a[^\n]*?a>", "")

    return F.transform(_unescape(F.transform(texts, before)), after)


def clean_text(text) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.get(clean_texts(F.array(text)), F.lit(0))


def paragraphs(text: Column) -> Column:
    """Texts between paragraph tags, without emphasis."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"<p>([^\n]*?)</p>"), F.lit(1)),
                       lambda p: F.regexp_replace(p, "</?em ?>", ""))


def shape(heading: Column, text: Column) -> Column:
    """Cleaned text as a list: paragraphs, listed subtypes, or the text itself."""
    bare = F.regexp_replace(text, "</?[emp]+ ?>", "")
    nothing = F.array().cast("array<string>")
    return (F.when(heading.isin(*PLAIN_HEADINGS), F.array(bare))
            .when((heading == LIST_HEADING) & F.contains(bare, F.lit("None")), nothing)
            .when(heading == LIST_HEADING, F.split(bare, "; "))
            .when(heading.isin(*PARAGRAPH_HEADINGS), paragraphs(text))
            .otherwise(F.array(text)))


def _common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit per character of ``a``."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - bin(row).count("1")


def title_similarity(title, target: str) -> Column:
    """Whole-number similarity 0-100: ``200 * common / (len a + len b)``, rounded."""

    @F.pandas_udf(T.IntegerType())
    def similarity(titles: pd.Series) -> pd.Series:
        def one(t):
            total = len(t) + len(target)
            return round(200 * _common_length(t, target) / total) if total else 100

        return titles.fillna("").map(one)

    return similarity(title)
