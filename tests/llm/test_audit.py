"""The filter audit against its definition, order by order."""

import re
from fractions import Fraction
from itertools import permutations

from cohortloom.llm import audit
from fixtures_llm import documents, no_docs  # noqa: F401

NAMES = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
         "good_lost", "toxic_lost", "shapley"]


def plain(docs, labels):
    """All rows, by applying the filters one after the other."""
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    held = []
    for i, t, p in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
                 "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
                 "E": i is not None and least[t] < i}
        held.append((p or "", {f for f in fails if fails[f]}, i in good, i in toxic))
    out, orders = [], ["".join(o) for o in permutations("ABCDE")]
    for part in {h[0] for h in held}:
        rows = [h[1:] for h in held if h[0] == part]
        steps, sums = [], dict.fromkeys("ABCDE", 0)
        for order in orders:
            left = list(rows)
            for n, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                sums[f] += len(gone)
                steps.append((part, order, n, len(left), len(gone), sum(f in r[0] for r in rows) - len(gone),
                              sum(r[0] == {f} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone), f))
        out += [(*s[:-1], sums[s[-1]]) for s in steps]
    return sorted(out)


def test_odd_rows_against_the_definition(spark):
    long = " ".join(f"w{i}" for i in range(250))
    docs = [(1, long, "en"), (2, long, "en"), (2, long, "en"), (None, long, "en"), (3, long, None), (9, None, ""),
            (4, "", "de"), (5, "ABC def", "de"), (6, "same " * 300, "fr"), (7, "same " * 300, "en"),
            (8, "50% off & more", "fr"), (10, long + " X" * 40, "fr"), (11, long + " |", "fr"), (None, "", "de"),
            (12, "a\x0bb\x1cc\x85d e " * 90, "fr"), (13, "x" * 200_000, "fr"), (1, "other", "en")]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (5, 1, 1), (6, None, 1), (None, 1, 1), (99, 1, 1), (11, 1, 0)]
    left = spark.createDataFrame([(*d, i) for i, d in enumerate(docs)],
                                 "doc_id long, text string, lang string, quality int")
    right = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, text string")
    got = audit.audit(left, right)
    assert got.columns == NAMES
    assert sorted(tuple(r) for r in got.collect()) == plain(docs, [r for r in labels if r[0] is not None])


def test_documents(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    got = sorted(tuple(r) for r in audit.audit(documents, labels).collect())
    assert got == plain([(r.doc_id, r.text, r.lang) for r in documents.collect()],
                        [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])


def test_no_documents(spark, no_docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    docs = no_docs.selectExpr("doc_id", "text", "'en' AS lang")
    assert audit.audit(docs, labels).count() == 0


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = audit.audit(docs, none).collect()
    assert len(rows) == 600 and sum(r.good_lost + r.toxic_lost for r in rows) == 0
    assert {(r.filter_order[r.step - 1], r.removed, r.shapley) for r in rows} >= {("A", 1, 120), ("B", 0, 0)}


def test_operator_is_the_average_over_orders():
    """Any game: the fit gives each player its mean gain over all orders."""
    size, value = 4, [(7 * s * s + 3 * s) % 23 for s in range(16)]
    value[0] = 0
    got = [sum(w * v for w, v in zip(row, value)) for row in audit.shapley_operator(size)]
    want = [Fraction(0)] * size
    for order in permutations(range(size)):
        before = 0
        for i in order:
            want[i] += Fraction(value[before | 1 << i] - value[before], 24)
            before |= 1 << i
    assert got == want and sum(got) == value[15]
