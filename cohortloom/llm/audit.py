"""Interaction of document filters: what each step of every order removes, and Shapley values.

Every document is one of 32 sets of failed filters.  All that is asked follows
from the removals of the 32 coalitions, a table of one row per part: a step's
removals are a difference of two coalitions, and the Shapley values are the
constrained least-squares fit of an additive game to the coalitions, solved
once in rational numbers.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame, Window, functions as F

FILTERS = "ABCDE"
SIZE = len(FILTERS)
ALL = (1 << SIZE) - 1

#: Limits of the filters: words, distinct words of a hundred, capitals of a hundred code points, signs.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SIGNS = 200, 50, 3, "[#$%&*|]"
SPACE = r"[\x20\x09-\x0D]+"


def solved(matrix: list[list[Fraction]], right: list[list[Fraction]]) -> list[list[Fraction]]:
    """X of ``matrix`` X = ``right`` by elimination in rational numbers."""
    rows = [list(m) + list(r) for m, r in zip(matrix, right)]
    n = len(matrix)
    for i in range(n):
        pivot = next(r for r in range(i, n) if rows[r][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for r in range(n):
            if r != i and rows[r][i]:
                rows[r] = [x - rows[r][i] * y for x, y in zip(rows[r], rows[i])]
    return [row[n:] for row in rows]


def shapley_operator(size: int) -> list[list[Fraction]]:
    """A row per player with its weight for the value of every coalition (by bit mask).

    Least squares over the coalitions S that are neither empty nor whole, with
    the kernel (n-1) / (C(n,|S|) |S| (n-|S|)) as weights, under the condition
    that the players' values add up to the whole coalition's.  The normal
    equations get that condition as one row and one multiplier more.
    """
    whole = (1 << size) - 1
    weight = {s: Fraction(size - 1, comb(size, s.bit_count()) * s.bit_count() * (size - s.bit_count()))
              for s in range(1, whole)}
    player = range(size)
    normal = [[sum(w for s, w in weight.items() if s >> i & s >> j & 1) for j in player] + [Fraction(1)]
              for i in player] + [[Fraction(1)] * size + [Fraction(0)]]
    right = [[weight.get(s, Fraction(0)) * (s >> i & 1) for s in range(whole + 1)] for i in player]
    right.append([Fraction(s == whole) for s in range(whole + 1)])
    return solved(normal, right)[:size]


def order_sums(size: int) -> list[list[int]]:
    """The operator times the number of orders: whole numbers, for sums over all orders."""
    scaled = [[x * factorial(size) for x in row] for row in shapley_operator(size)]
    assert all(x.denominator == 1 for row in scaled for x in row)
    return [[int(x) for x in row] for row in scaled]


def failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails; the text is not null."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]", ""))
    fails = (F.size(words) < LEAST_WORDS,
             100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * F.size(words),
             100 * capitals.cast("long") > MOST_CAPITALS * F.length(text).cast("long"),
             text.rlike(SIGNS))
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def profiles(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             part_col: str = "lang") -> DataFrame:
    """(part, mask, good, toxic, n): documents by part, failed filters and labels.

    A text is known by its SHA-256.  Rows of one id and text are added up before
    they meet anything, and those of one text before its least id is sought, so
    a text that a third of all rows repeat is a row per task and kind.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       failures(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest")) \
        .groupBy("id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(
        *(F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))))
    kind = ["digest", "part", "mask", "good", "toxic"]
    kinds = rows.join(marks, "id", "left").fillna(False, ["good", "toxic"]) \
        .groupBy(*kind).agg(F.sum("n").alias("n"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"),
                            F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("nameless"))
    least = F.min("first.id").over(Window.partitionBy("digest"))
    first = F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    counted = kinds.withColumn("least", least).withColumn("unlike", F.col("nameless") + first)
    repeat = F.lit(1 << FILTERS.index("E"))
    both = F.array(F.struct("mask", F.col("unlike").alias("n")),
                   F.struct((F.col("mask") + repeat).alias("mask"), (F.col("n") - F.col("unlike")).alias("n")))
    return counted.select("part", "good", "toxic", F.inline(both)).where("n > 0") \
        .groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def coalitions(profile: DataFrame) -> DataFrame:
    """(part, total, v, good, toxic): a row per part with the removals of each coalition,
    by bit mask, of all documents, of good and of toxic ones."""
    def removals(counted: Column) -> Column:
        return F.array(*(F.coalesce(F.sum(F.when(F.col("mask").bitwiseAND(s) != 0, counted)), F.lit(0))
                         for s in range(ALL + 1)))

    n = F.col("n")
    return profile.groupBy("part").agg(
        F.sum("n").alias("total"), removals(n).alias("v"),
        removals(F.when(F.col("good"), n)).alias("good"), removals(F.when(F.col("toxic"), n)).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          part_col: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley): every step of all orders of the filters, per part.

    A null part is the empty string, a null text the empty text (which fails A
    alone, and E after the first).  Filter E looks for the same text under a
    smaller id in the whole table; rows that repeat an id and text do not fail
    it for each other, and rows with a null id neither fail it nor make others
    fail.  Repeated rows count each; of repeated labels one that says 1 is
    enough; other columns are not read; no documents give no rows.
    """
    table = coalitions(profiles(docs, labels, id_col, text_col, part_col))
    orders = F.array(*(F.struct(F.lit("".join(o)).alias("filter_order"),
                                F.array(*(F.lit(1 << FILTERS.index(f)) for f in o)).alias("bits"))
                       for o in permutations(FILTERS)))
    sums = F.array(*(sum((weight * F.col("v")[s] for s, weight in enumerate(row) if weight), F.lit(0).cast("long"))
                     for row in order_sums(SIZE)))
    steps = table.withColumn("sums", sums).withColumn("o", F.explode(orders)) \
        .select("*", F.posexplode("o.bits").alias("at", "bit")) \
        .withColumn("before", F.aggregate(F.slice("o.bits", 1, F.col("at")), F.lit(0), lambda a, x: a + x)) \
        .withColumn("after", F.col("before") + F.col("bit"))

    def step(values: str) -> Column:
        return F.get(values, F.col("after")) - F.get(values, F.col("before"))

    return steps.select(
        "part", F.col("o.filter_order").alias("filter_order"), (F.col("at") + 1).alias("step"),
        (F.col("total") - F.get("v", F.col("after"))).alias("kept"), step("v").alias("removed"),
        (F.get("v", F.col("bit")) - step("v")).alias("redundant"),
        (F.get("v", F.lit(ALL)) - F.get("v", F.lit(ALL) - F.col("bit"))).alias("unique_fails"),
        step("good").alias("good_lost"), step("toxic").alias("toxic_lost"),
        F.get("sums", F.log2(F.col("bit")).cast("int")).alias("shapley"))
