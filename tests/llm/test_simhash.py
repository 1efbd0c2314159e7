"""Golay keys miss no link; groups equal those of a brute-force comparison."""

import re

import numpy as np
import xxhash

from fixtures_llm import documents, no_docs, odd  # noqa: F401
from cohortloom.llm import simhash
from cohortloom.llm.components import components


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                group[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def test_every_word_is_near_one_codeword():
    code = simhash.Golay()
    words = np.arange(1 << 23)
    assert set(np.unique(code.size[code.syndrome(words[:5000])])) <= {1, 6}
    assert all(len(set(c[m])) == m.sum() for c, m in zip(*code.nearby(words[:3000])))


def test_links_share_a_key():
    rnd, code = np.random.default_rng(5), simhash.Golay()
    for _ in range(400):
        a = rnd.integers(0, 2**64, dtype=np.uint64)
        b = a
        for bit in rnd.choice(64, rnd.integers(0, 5), replace=False):
            b ^= np.uint64(1) << np.uint64(bit)
        keys = [set(simhash.keys_of(np.array([x]).view(np.int64), code)[0]) for x in (a, b)]
        assert keys[0] & keys[1]


def test_groups_match_brute_force(documents):
    want = plain_groups([tuple(r) for r in documents.select("doc_id", "text").collect()])
    got = simhash.near_duplicates(documents).collect()
    assert sorted((tuple(r) for r in got), key=repr) == want


def test_chain_of_links_over_buckets(spark):
    """Fingerprints of which neighbours differ by four bits hang together whole."""
    chain, fp = [], 0
    for step in range(14):
        chain.append(fp)
        for bit in range(4):
            fp ^= 1 << (step * 4 + bit)
    far = (1 << 64) - 1
    rows = [(x - (1 << 64) if x >> 63 else x,) for x in [*chain, far]]
    got = {r.fp: r.root for r in simhash.linked(spark.createDataFrame(rows, "fp long")).collect()}
    assert len({got[x] for x in chain}) == 1 and len(set(got.values())) == 2


def test_random_clusters_match_brute_force(spark):
    """Dense groups, far ones, and members that only meet others outside the hub's reach."""
    rnd, fps = np.random.default_rng(2), set()
    for _ in range(12):
        base = int(rnd.integers(0, 2**64, dtype=np.uint64))
        for _ in range(40):
            mark = base
            for bit in rnd.choice(64, rnd.integers(0, 6), replace=False):
                mark ^= 1 << int(bit)
            fps.add(mark)
    fps = sorted(fps)
    group = {x: x for x in fps}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4:
                group[find(a)] = find(b)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    got = {r.fp: r.root for r in simhash.linked(
        spark.createDataFrame([(signed(x),) for x in fps], "fp long")).collect()}
    pairs = {(find(x), got[signed(x)]) for x in fps}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_odd_rows(odd):
    from fixtures_llm import ODD

    got = simhash.near_duplicates(odd("fingerprint")).collect()
    kept = simhash.keep_one(odd("text_hash"))
    assert kept.columns == ["doc_id", "text", "text_hash"]
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == [1, 2, 5, None]
    assert sorted((tuple(r) for r in got), key=repr) == plain_groups([r[:2] for r in ODD])


def test_empty_table(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (7, 7), (None, 3), (40, 41), (41, 40)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(31)} | {100: 100, 101: 100, 102: 100, 40: 40, 41: 40}
    assert got == want
