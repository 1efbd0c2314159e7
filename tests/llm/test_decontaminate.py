"""Verdicts equal a comparison of every stretch of tokens; substitutions are tolerated."""

import math
import random
import re
from itertools import combinations

import pytest

from fixtures_llm import ODD, documents, no_docs, odd  # noqa: F401
from cohortloom.llm import decontaminate as dc

ITEMS = "item_id long, text string"


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def share(doc, item):
    """Best share of equal tokens over all placements and stretches, 0 if none counts."""
    n, best = min(len(item), dc.OVERLAP), 0.0
    for at in range(len(doc) - n + 1):
        for start in range(len(item) - n + 1):
            same = sum(doc[at + i] == item[start + i] for i in range(n))
            if same / n >= dc.SHARE and (len(item) >= dc.OVERLAP or same == n):
                best = max(best, same / n)
    return best


def check(spark, docs, items, **more):
    df = spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id long, text string, contaminated string")
    out = dc.overlaps(df, spark.createDataFrame(items, ITEMS), **more).collect()
    hit = {r.doc_id for r in out}
    want = {i for i, t in docs if any(item and share(words(t), words(item)) for _, item in items)}
    assert hit == want
    verdicts = {r.doc_id: r.contaminated for r in dc.contamination(df, spark.createDataFrame(items, ITEMS)).collect()}
    assert {i for i, bad in verdicts.items() if bad} == want and set(verdicts) == {i for i, _ in docs}


def test_seeds_fit_wherever_two_of_an_overlap_differ():
    tolerated = dc.OVERLAP - math.ceil(dc.SHARE * dc.OVERLAP)
    for wrong in combinations(range(dc.OVERLAP), tolerated):
        assert any(not set(wrong) & {at + m for m in mask}
                   for mask in dc.MASKS for at in range(dc.OVERLAP - mask[-1]))


@pytest.mark.parametrize("broadcast_rows", [dc.BROADCAST_ROWS, 0])
def test_like_brute_force(spark, broadcast_rows):
    rnd = random.Random(11)
    pool = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rnd.choices(pool, k=n))) for i, n in enumerate((13, 14, 20, 40, 5, 2, 30))]
    docs = []
    for i in range(60):
        passage = items[i % len(items)][1].split()
        cut = passage[rnd.randint(0, 3):len(passage) - rnd.randint(0, 3)] if len(passage) > 8 else passage
        for at in rnd.sample(range(len(cut)), min(len(cut), rnd.randint(0, 3))):
            cut[at] = "changed"
        docs.append((i, " ".join(rnd.choices(pool, k=20) + cut + rnd.choices(pool, k=rnd.randint(0, 9)))))
    docs.append((99, "w1, W2. w3!"))
    check(spark, docs, items, broadcast_rows=broadcast_rows)


def test_odd_rows(spark, odd, no_docs):
    items = spark.createDataFrame([(1, "one two three four five six"), (2, None), (3, ""), (None, "zzz"),
                                   (4, "One two, three four five SIX")], ITEMS)
    got = sorted((tuple(r) for r in dc.contamination(odd("first_item"), items).collect()), key=repr)
    assert [(r[0], r[1]) for r in got if r[1]] == [(1, True), (1, True)]
    assert [r[2:] for r in got if r[1]] == [(1, 1, 1.0)] * 2
    assert len(got) == len(ODD)
    assert dc.contamination(no_docs, items).count() == 0
    assert not any(r.contaminated for r in dc.contamination(
        odd(), items.limit(0)).collect())
    kept = dc.remove(odd("same_id"), items)
    assert kept.columns == ["doc_id", "text", "same_id"]
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(
        (i for i, *_ in ODD if i != 1), key=repr)


def test_whole_tables(spark, documents):
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = {r.doc_id for r in dc.contamination(documents, benchmark).collect() if r.contaminated}
    items = [words(r.text) for r in benchmark.collect()]
    runs = {tuple(i[k:k + 13]) for i in items for k in range(len(i) - 12)}
    exact = {r.doc_id for r in documents.collect() if any(
        tuple(w[k:k + 13]) in runs for w in [words(r.text)] for k in range(len(w) - 12))}
    assert exact and exact <= got


def test_short_masks_fit_wherever_the_tolerated_tokens_differ():
    for lengths, masks in dc.SHORT_MASKS.items():
        for n in lengths:
            for wrong in combinations(range(n), n - math.ceil(dc.SHARE * n)):
                assert any(not set(wrong) & {at + m for m in mask}
                           for mask in masks for at in range(n - mask[-1])), (n, wrong)


def whole_share(doc, item):
    """Best share of the item's tokens that agree, at any placement, over the text's ends too."""
    n = len(item)
    return max((sum(0 <= at + i < len(doc) and doc[at + i] == t for i, t in enumerate(item)) / n
                for at in range(1 - n, len(doc))), default=0.0)


def test_short_items_tolerate_substitutions(spark):
    rnd = random.Random(5)
    pool = [f"w{i}" for i in range(40)]
    items = [(n, " ".join(rnd.choices(pool, k=n))) for n in range(1, 13)]
    docs, key = [], 0
    for n, passage in items:
        for wrong in range(min(n, 4)):
            for _ in range(3):
                cut = passage.split()
                for at in rnd.sample(range(n), wrong):
                    cut[at] = f"x{key}"
                # At the text's start, its end, or alone, so that the ends cut nothing off, or one token off.
                head, tail = rnd.randint(0, 5), rnd.randint(0, 5)
                words_of = [f"y{key}"] * head + cut[rnd.randint(0, 1) if n > 6 else 0:] + [f"z{key}"] * tail
                docs.append((key, " ".join(words_of)))
                key += 1
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for broadcast_rows in (dc.BROADCAST_ROWS, 0):
        got = {(r.doc_id, r.item): r.share for r in dc.overlaps(
            df, spark.createDataFrame(items, ITEMS), broadcast_rows=broadcast_rows).collect()}
        want = {}
        for i, t in docs:
            for n, item in items:
                best = whole_share(words(t), words(item))
                if best == 1 or n >= dc.WHOLE and best >= dc.SHARE:
                    want[i, n] = best
        assert got == pytest.approx(want) and any(0 < v < 1 for v in want.values())
