"""The model equals one made of dictionaries; its probabilities sum to one."""

import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from fixtures_llm import documents, no_docs, odd  # noqa: F401
from cohortloom.llm import ngram_lm as lm


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def top(word):
    return xxhash.xxh64_intdigest(word.encode()) >> 32 if word not in ("\n", "\t") \
        else {"\n": lm.END, "\t": lm.START}[word] >> 32


class Plain:
    """Interpolated modified Kneser-Ney with words for keys."""

    def __init__(self, texts):
        runs = [["\t", *words(t), "\n"] for t in texts]
        self.c = Counter(w for r in runs for w in r[1:])
        self.pair = Counter(p for r in runs for p in zip(r, r[1:]))
        self.follow = Counter(w for _, w in self.pair)
        self.of = defaultdict(list)
        for (v, _), n in self.pair.items():
            self.of[v].append(n)
        steps = lambda c: [sum(n == k for n in c.values()) for k in (1, 2, 3, 4)]
        self.d, self.e = lm.discounts(steps(self.pair)), lm.discounts(steps(self.follow))
        self.spare = sum(self.cost(n, self.e) for n in self.follow.values()) / max(len(self.pair), 1)

    @staticmethod
    def cost(n, d):
        return d[min(n, 3) - 1] if n else 0.0

    def p(self, v, w):
        n = self.follow[w]
        low = (n - self.cost(n, self.e)) / len(self.pair) + self.spare / (len(self.c) + 1)
        if v not in self.of:
            return low
        c, total = self.pair[v, w], sum(self.of[v])
        return (c - self.cost(c, self.d)) / total + sum(self.cost(n, self.d) for n in self.of[v]) / total * low


def brute(rows, folds=7, fold=2):
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % folds == fold
    model = Plain([t for i, t in rows if not out(i)])
    total, kinds = sum(model.c.values()), len(model.c)
    result = []
    for i, text in rows:
        run = ["\t", *words(text), "\n"]
        result.append((i, out(i), len(run) - 1, sum(model.c[w] > 0 for w in run[1:]), total,
                       sum(math.log10((model.c[w] + 1) / (total + kinds + 1)) for w in run[1:]),
                       sum(math.log10(model.p(v, w)) for v, w in zip(run, run[1:]))))
    return result


def same(got, want):
    key = lambda r: (repr(r[:5]), round(r[5], 4))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)


def test_matches_dictionaries(documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    tops = {top(w) for _, t in rows for w in words(t)}
    assert len(tops) == len({w for _, t in rows for w in words(t)})  # no halves collide here
    same(lm.score_texts(documents).collect(), brute(rows))


def test_probabilities_sum_to_one(documents):
    model = Plain([r.text for r in documents.limit(40).collect()])
    for v in ("the", "\t", "de"):
        known = sum(model.p(v, w) for w in model.c)
        assert known + model.p(v, "no such word") == pytest.approx(1.0)


def test_odd_rows(odd):
    from fixtures_llm import ODD

    same(lm.score_texts(odd("score")).collect(), brute([r[:2] for r in ODD]))


def test_empty_table_and_no_training(spark, no_docs):
    assert lm.score_texts(no_docs).count() == 0
    alone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = lm.score_texts(spark.createDataFrame([(alone, "a b")], "doc_id long, text string")).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.score) == (3, 0, 0, 0.0)


def test_one_word_fills_no_shard():
    """The followers of a word that comes before all others spread over the shards."""
    rnd = np.random.default_rng(8)
    keys = np.unique((np.uint64(7) << np.uint64(32)) | rnd.integers(0, 1 << 32, 40_000, np.uint64))
    rows = lm.parts("pair", keys, np.ones(len(keys), np.uint64), 16).to_pylist()
    sizes = [len(r["keys"]) // 8 for r in rows]
    assert len(rows) == 16 and sum(sizes) == len(keys) and max(sizes) < 1.2 * len(keys) / 16


def test_merging_holds_a_shard_few_times_over():
    keys = np.arange(200_000, dtype=np.uint64) * np.uint64(7919)
    rows = pa.Table.from_batches([lm.parts("pair", keys, np.ones(len(keys), np.uint64), 1) for _ in range(4)])
    tracemalloc.start()
    found, counts = lm.merged(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (found == keys).all() and (counts == 4).all()
    assert peak < 50 * 4 * len(keys)  # 46 bytes a key; 54 while every row was copied before any was merged
