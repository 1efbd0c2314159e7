"""Fixed patterns equal plain regular expressions; the field finds what they lose."""

import random
import re
from collections import Counter

import numpy as np

from fixtures_llm import ODD, documents, no_docs, odd  # noqa: F401
from cohortloom.llm import pii

CARD = "4041894974608795"


def digits(text):
    return re.sub("[^0-9]", "", text)


def plain(text):
    """The patterns as they are written, one after the other."""
    found = [(m.start(), 0, m.end()) for m in
             re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in
              re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
              if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10))
                    for i, d in enumerate(reversed(digits(m.group()))))
        if 12 <= len(digits(m.group())) <= 19 and total % 10 == 0:
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
              if 9 <= len(digits(m.group())) <= 15]
    return sorted(found)


def field(texts):
    cells = Counter()
    for t in texts:
        cells.update(pii.count_cells(t))
    table = np.zeros(pii.CELLS)
    for cell, n in cells.items():
        table[cell] = n
    return pii.estimate(table)


def test_patterns_on_noise():
    rnd = random.Random(8)
    for _ in range(20_000):
        text = "".join(rnd.choice("a1 2@.@..-+()5é%0") for _ in range(rnd.randint(0, 60)))
        assert [tuple(s) for s in pii.base_spans(text)] == plain(text), text


def test_long_runs_are_quick():
    for text in ("1" * 200_000, "a@" * 100_000, "a" * 200_000 + "@", "1." * 100_000, "+1" + "(" * 100_000):
        pii.candidates(text), pii.base_spans(text)


def taught():
    good = [f"call +1 (269) 555-3{n:03d} or pay {CARD} from 10.0.{n}.1 as a{n}@b.org now" for n in range(100)]
    return field([*good, *(f"version 2.{n} of {n}00 parts" for n in range(100))])


def test_neighbours_that_patterns_merge():
    """Digits that stand beside each other are one failing match; the field parts them."""
    text = f"erntou +1 (269) 555-3296 {CARD} and on"
    base, spans = pii.spans_of(taught(), text)
    assert not base
    assert [(pii.KINDS[s.kind], text[s.start:s.end]) for s in spans] == [
        ("phone", "+1 (269) 555-3296"), ("card", CARD)]


def test_repeats_share_a_label():
    """An unlikely dress of a known entity is taken because the plain one stands far away."""
    alone = "ref 4041/8949/7460/8795 end"
    text = f"pay {CARD} " + "word " * 50 + alone
    model = taught()
    strong = model._replace(skip=np.log(np.where(np.eye(5) > 0, 50.0, 0.02)))
    assert not pii.spans_of(strong, alone)[1]
    tokens = pii.candidates(text)
    assert pii.observed(tokens, pii.base_spans(text)).tolist() == [3, 0]
    assert pii.edges(tokens)[1].tolist() == [] and len(pii.edges(pii.candidates(text + " 7 " + CARD))[1]) == 1
    spans = pii.spans_of(strong, text + " 7")[1]
    assert [text[s.start:s.end] for s in spans][:1] == [CARD]


def test_skip_edges_join_distant_tokens_alike():
    text = f"pay {CARD} word 12 ref 4041/8949/7460/8795 end"
    strong = taught()._replace(skip=np.log(np.where(np.eye(5) > 0, 50.0, 0.02)))
    assert pii.edges(pii.candidates(text))[1].tolist() == [[0, 2]]
    assert [text[s.start:s.end] for s in pii.spans_of(strong, text)[1]] == [CARD, "4041/8949/7460/8795"]


def test_messages_are_exact_on_a_chain():
    """Without loops the messages give the marginals of the sum over all labellings."""
    from itertools import product

    model = taught()
    tokens = pii.candidates("x +1 (269) 12.5 7 y")
    label = np.zeros(len(tokens), int)
    unary = model.unary[pii.features(tokens)]
    total = np.zeros((len(tokens), pii.LABELS))
    for ls in product(range(pii.LABELS), repeat=len(tokens)):
        weight = np.exp(sum(unary[i, k] for i, k in enumerate(ls))
                        + sum(model.chain[a, b] for a, b in zip(ls, ls[1:])))
        for i, k in enumerate(ls):
            total[i, k] += weight
    assert np.allclose(pii.marginals(model, tokens, label), total / total.sum(axis=1, keepdims=True), atol=1e-3)


def test_rows(documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    rows = pii.find(documents).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = [(pii.KINDS[k], a, b) for a, k, b in plain(texts[r.doc_id])]
        assert [tuple(s) for s in r.base] == want
        assert set(want) <= {tuple(s) for s in r.spans}
    none = [r for r in rows if not re.search(r"[0-9@]", texts[r.doc_id])]
    assert none and not any(r.spans for r in none)


def test_odd_rows(odd, no_docs):
    rows = pii.find(odd("spans")).collect()
    assert sorted((r.doc_id for r in rows), key=repr) == sorted((r[0] for r in ODD), key=repr)
    assert pii.find(no_docs).count() == 0


def test_redact(spark):
    docs = spark.createDataFrame([(1, f"a é {CARD}.", 21, "x"), (2, None, None, "y"), (3, "plain", 5, "z")],
                                 "doc_id long, text string, n_chars long, score string")
    got = sorted(tuple(r) for r in pii.redact(docs).collect())
    assert got == [(1, "a é <card>.", 11, "x"), (2, None, None, "y"), (3, "plain", 5, "z")]
