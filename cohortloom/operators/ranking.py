"""Exact ranks and running totals over groups of any size.

A plain ``Window.partitionBy(key)`` sorts a whole key in one task.  Here every
key is cut into ordered buckets; a small table of bucket totals gives each
bucket its offset, and only the rows of one (key, bucket) are sorted together.
The answer is the same as the plain window's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut

HASH_BUCKETS = 1024
CHUNK = 16


def hash_rank(df: DataFrame, keys: list[str], unit: Column, tie: str,
              rank: str = "rank", size: str = "group_size",
              buckets: int = HASH_BUCKETS) -> DataFrame:
    """Rank rows of each key by a shuffling number ``unit`` in [0, 1).

    Adds the 1-based ``rank`` (ties by ``tie``) and the key's ``size``.  ``unit``
    is spread evenly, so equal slices of [0, 1) hold equal shares of any key.
    """
    rows = df.withColumn("_u", unit)
    rows = rows.withColumn("_b", F.floor(F.col("_u") * buckets).cast("int"))
    totals = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    by_key = Window.partitionBy(*(keys or [F.lit(0)]))
    before = by_key.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_bb"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
        F.sum("_n").over(by_key).alias(size))
    same = F.col("_b") == F.col("_bb")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inner = Window.partitionBy(*keys, "_b").orderBy("_u", tie)
    return (rows.withColumn("_r", F.row_number().over(inner))
            .join(offsets, same)
            .withColumn(rank, F.col("_off") + F.col("_r"))
            .drop("_u", "_b", "_r", "_bb", "_off", *[f"_k{i}" for i in range(len(keys))]))


def running(df: DataFrame, keys: list[str], order: str, sums: tuple[str, ...] = (),
            maxes: tuple[str, ...] = (), buckets: int = 256) -> DataFrame:
    """Running sums and maxima within each key, by descending ``order``.

    Bucket borders are approximate quantiles per key, written to the checkpoint
    folder so that both uses see the same borders; the results do not depend on
    where they fall.  Rows that tie on (key, order) follow each other in any
    order.  Adds ``cum_<c>`` and ``total_<c>`` for sums, ``top_<c>`` for maxima.
    """
    shares = [i / buckets for i in range(1, buckets)]
    every = F.array_distinct(F.percentile_approx(order, shares, 1000))
    # Borders in chunks: a row looks at the chunks' ends, then into one chunk.
    chunks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("_every") - 1) / CHUNK).cast("int")),
        lambda i: F.slice("_every", i * CHUNK + 1, F.lit(CHUNK)))
    borders = cut(df.groupBy(*keys).agg(every.alias("_every")).withColumn(
        "_chunks", chunks).select(*keys, "_chunks", F.transform(
            "_chunks", lambda c: F.array_max(c)).alias("_ends")))
    reached = lambda some: F.size(F.filter(some, lambda x: x <= F.col(order)))
    none = F.array().cast(f"array<{df.schema[order].dataType.simpleString()}>")
    rows = df.join(borders, keys).withColumn("_c", reached("_ends")).withColumn(
        "_b", -(F.col("_c") * CHUNK + reached(F.coalesce(F.get("_chunks", F.col("_c")), none)))
    ).drop("_ends", "_chunks", "_c")
    totals = rows.groupBy(*keys, "_b").agg(
        *[F.sum(c).alias(f"_t{c}") for c in sums], *[F.max(c).alias(f"_m{c}") for c in maxes])
    by_key = Window.partitionBy(*keys)
    before = by_key.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_b",
        *[F.coalesce(F.sum(f"_t{c}").over(before), F.lit(0)).alias(f"_o{c}") for c in sums],
        *[F.sum(f"_t{c}").over(by_key).alias(f"total_{c}") for c in sums],
        *[F.max(f"_m{c}").over(before).alias(f"_p{c}") for c in maxes])
    inner = Window.partitionBy(*keys, "_b").orderBy(F.desc(order)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    within = rows.select("*", *[F.sum(c).over(inner).alias(f"_w{c}") for c in sums],
                         *[F.max(c).over(inner).alias(f"_x{c}") for c in maxes])
    added = {f"cum_{c}": F.col(f"_o{c}") + F.col(f"_w{c}") for c in sums}
    added |= {f"top_{c}": F.greatest(f"_p{c}", f"_x{c}") for c in maxes}
    return within.join(offsets, [*keys, "_b"]).withColumns(added).drop(
        "_b", *[f"_{t}{c}" for t in "ow" for c in sums], *[f"_{t}{c}" for t in "px" for c in maxes])


def quantiles(df: DataFrame, keys: list[str], order: str, shares: list[float]) -> DataFrame:
    """(keys, share, value, n): exact quantiles of each key, null values left out.

    A quantile between two ranks is taken linearly between their values.  Equal
    values are counted first, then running counts say which ranks a value covers.
    """
    counts = df.filter(F.col(order).isNotNull()).groupBy(*keys, order).agg(
        F.count(F.lit(1)).alias("n"))
    # Counted from the greatest value down, so what is left over lies below.
    ranks = running(counts, keys, order, ("n",)).select(
        *keys, F.col(order).cast("double").alias("v"), F.col("total_n").alias("total"),
        (F.col("total_n") - F.col("cum_n")).alias("first"),
        (F.col("total_n") - F.col("cum_n") + F.col("n") - 1).alias("last"),
        F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share"))
    at = (F.col("total") - 1) * F.col("share")
    covers = lambda rank: rank.between(F.col("first"), F.col("last"))
    low, high = covers(F.floor(at)), covers(F.ceil(at))
    found = ranks.filter(low | high).groupBy(*keys, "share", "total").agg(
        F.max(F.when(low, F.col("v"))).alias("low"), F.max(F.when(high, F.col("v"))).alias("high"))
    return found.select(*keys, "share", (
        F.col("low") + (at - F.floor(at)) * (F.col("high") - F.col("low"))).alias("value"),
        F.col("total").alias("n"))
