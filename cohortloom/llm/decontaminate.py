"""Benchmark passages in training texts, found by spaced-seed hashes; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import free_name

#: Tokens of an overlap that counts, and the share of them that must be equal.
OVERLAP = 13
SHARE = 0.8
#: Token positions that a seed looks at; those between may differ.  Wherever two
#: of ``OVERLAP`` tokens in a row differ, one of the seeds still fits among them.
MASKS = ((0, 3, 6, 7, 8, 9), (0, 1, 3, 4, 6, 10))
#: Shorter items are compared whole; those of fewer tokens than ``WHOLE`` must be there unchanged.
WHOLE = 7
#: Masks of such items by the lengths they serve: up to 9 tokens one may differ, up to 12 two.
SHORT_MASKS = {range(7, 10): ((0, 1, 2, 3), (0, 1, 4, 5)),
               range(10, 13): ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5), (0, 1, 3, 6, 7))}
#: Seed rows of a benchmark (about 50 bytes each) up to which they are sent to every executor.
BROADCAST_ROWS = 1_000_000


def tokens(text: Column) -> Column:
    """Hashes of the lower-cased runs of letters and digits; none for null."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seed(mask, at: Column, of: str) -> Column:
    """Hash of the masked tokens from position ``at`` on; null past either end."""
    inside = (at >= 0) & (at + mask[-1] < F.size(of))
    return F.when(inside, F.xxhash64(F.lit(",".join(map(str, mask))),
                                     *(F.get(of, at + m) for m in mask)))


def _seeds(rows: DataFrame, masks, of: str, keep: list[str]) -> DataFrame:
    """One row per position and mask: the mask's number and the seed there."""
    at = rows.select(*keep, of, F.posexplode_outer(of).alias("pos", "_token"))
    numbered = [x for n, m in enumerate(masks) for x in (F.lit(n), _seed(m, F.col("pos"), of))]
    return at.select(*keep, of, "pos", F.stack(F.lit(len(masks)), *numbered).alias("mask", "seed")) \
        .where("seed IS NOT NULL")


def _before(masks, pos: str, of: str) -> Column:
    """The seed of the row's mask one position before; null at the start."""
    return F.coalesce(*(F.when(F.col("mask") == n, _seed(m, F.col(pos) - 1, of))
                        for n, m in enumerate(masks)))


def _best(doc: Column, item: Column, start: Column) -> Column:
    """Largest share of equal tokens in any stretch of the overlap's length.

    ``item`` lies beside ``doc`` from position ``start`` on, which may be negative.
    """
    same = F.transform(item, lambda t, i: F.when(
        (start + i >= 0) & (F.get(doc, start + i) == t), 1).otherwise(0))
    need = F.least(F.size(item), F.lit(OVERLAP))
    return F.array_max(F.transform(
        F.sequence(F.lit(0), F.size(item) - need),
        lambda i: F.aggregate(F.slice(same, i + 1, need), F.lit(0), lambda n, x: n + x))) / need


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             item_col: str = "item_id", item_text: str = "text",
             broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(id, text_hash, item, share): verified overlaps, one row per text and item.

    Only the first seed of a run of equal seeds is verified, so that a whole
    passage costs a few rows and not one per position and mask.  Where the
    counted seed table is too large to broadcast, seeds alone are shuffled and
    the texts of the hits are fetched afterwards.
    """
    items = benchmark.select(F.col(item_col).alias("item"), tokens(F.col(item_text)).alias("item_tokens")) \
        .where(F.size("item_tokens") > 0).groupBy("item_tokens").agg(F.min("item").alias("item")) \
        .withColumn("item", F.struct("item", F.xxhash64("item_tokens").alias("hash")))
    # Every mask serves items of certain lengths; only masks that have such items are used.
    short = sorted(r[0] for r in items.where(F.size("item_tokens") < OVERLAP)
                   .select(F.size("item_tokens")).distinct().collect())
    serves = [(mask, None) for mask in MASKS] + [
        (tuple(range(n)), [n]) for n in short if n < WHOLE] + [
        (mask, [n for n in short if n in lengths])
        for lengths, some in SHORT_MASKS.items() if not set(lengths).isdisjoint(short) for mask in some]
    masks = [mask for mask, _ in serves]
    served = F.lit(False)
    for n, (_, lengths) in enumerate(serves):
        fits = F.col("length") >= OVERLAP if lengths is None else F.col("length").isin(lengths)
        served = served | ((F.col("mask") == n) & fits)
    listed = _seeds(items, masks, "item_tokens", ["item"]).select(
        "mask", "seed", F.col("pos").alias("item_pos"), "item", F.size("item_tokens").alias("length"),
        _before(masks, "pos", "item_tokens").alias("item_before")) \
        .where(served).drop("mask")
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("text_hash"),
                       tokens(F.col(text_col)).alias("doc_tokens"))
    text = ["_id", "text_hash"]
    first = F.coalesce(F.col("before") != F.col("item_before"), F.lit(True))
    before = _before(masks, "pos", "doc_tokens")
    shift = (F.col("pos") - F.col("item_pos")).alias("shift")
    seeds = _seeds(rows, masks, "doc_tokens", text)
    if listed.count() <= broadcast_rows:
        hits = seeds.join(F.broadcast(listed), "seed").withColumn("before", before).where(first) \
            .select(*text, "item", shift, "length", "doc_tokens")
    else:
        found = seeds.select(*text, "pos", "seed", before.alias("before")).join(listed, "seed") \
            .where(first).select(*text, "item", shift, "length").distinct()
        rows = rows.dropDuplicates(text).select(F.col("_id").alias("same_id"),
                                                F.col("text_hash").alias("same_hash"), "doc_tokens")
        hits = found.join(rows, F.col("_id").eqNullSafe(F.col("same_id"))
                          & (F.col("text_hash") == F.col("same_hash")))
    # Of the text only the part beside the item goes on.
    beside = F.slice("doc_tokens", F.greatest("shift", F.lit(0)) + 1,
                     F.col("length") + F.least("shift", F.lit(0)))
    hits = hits.select(*text, "item", "length", F.least("shift", F.lit(0)).alias("start"), beside.alias("beside"))
    share = _best(F.col("beside"), F.col("item_tokens"), F.col("start"))
    return hits.join(items, "item").groupBy(*text, "length", F.col("item.item").alias("item"), "item.hash") \
        .agg(F.max(share).alias("share")) \
        .where(F.col("share") >= F.when(F.col("length") < WHOLE, 1.0).otherwise(SHARE)) \
        .select(F.col("_id").alias(id_col), "text_hash", "item", "share")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id",
                  item_text: str = "text") -> DataFrame:
    """(id, contaminated, n_items, first_item, best_share) for every document.

    A document is contaminated if 13 of its tokens in a row agree in at least 80
    of 100 with as many of an item.  Shorter items are compared whole: from seven
    tokens on at least 80 of 100 must agree in their places (places beyond the
    text's ends do not), fewer tokens must be there unchanged.  Items with the same tokens count as one, under the least
    id.  Null and empty texts and items overlap with nothing; a repeated row
    gets the same verdict; other columns are not read.  The benchmark's seeds
    are broadcast only after they are counted; beyond the bound Spark chooses
    the join.
    """
    found = overlaps(docs, benchmark, id_col, text_col, item_col, item_text) \
        .groupBy(F.col(id_col).alias("_id"), "text_hash", "item").agg(F.max("share").alias("share")) \
        .groupBy("_id", "text_hash").agg(F.count("*").alias("n_items"), F.min("item").alias("first_item"),
                                         F.max("share").alias("best_share"))
    rows = docs.select(F.col(id_col), F.xxhash64(text_col).alias("_hash"))
    return rows.join(found, rows[id_col].eqNullSafe(F.col("_id"))
                     & (F.col("_hash") == F.col("text_hash")), "left").select(
        rows[id_col], F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"), "first_item",
        F.coalesce("best_share", F.lit(0.0)).alias("best_share"))


def remove(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents without a verified overlap, with their own columns.

    Null and empty texts stay; a repeated row stays or goes as often as it is there.
    """
    same_id, same_hash = (free_name(docs.columns, c) for c in ("same_id", "same_hash"))
    found = overlaps(docs, benchmark, id_col, text_col, item_col, item_text) \
        .select(F.col(id_col).alias(same_id), F.col("text_hash").alias(same_hash)).distinct()
    return docs.join(found, F.col(id_col).eqNullSafe(F.col(same_id))
                     & (F.xxhash64(text_col) == F.col(same_hash)), "left_anti")
