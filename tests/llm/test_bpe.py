"""Encodings equal the tokenizer libraries', joins equal whole merges, decoding gives the text back."""

import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from fixtures_llm import ODD, documents, no_docs, odd  # noqa: F401
from cohortloom.llm import bpe, byte_bpe, token_counts

RANKS, COUNTS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, special_tokens={},
                             mergeable_ranks=bpe.load_ranks(RANKS))


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(COUNTS)


def odd_texts():
    rnd = random.Random(4)
    mixed = ["".join(rnd.choice("ab  \n\t'sé1²漢😀\x1c\x85\xa0<|endoftext|>") for _ in range(n % 60))
             for n in range(600)]
    long = ["a" * 3000, "ab" * 1500, " " * 2000, "é" * 1000, "<|endoftext|>" * 3, "<|endoftext|> x",
            "".join(rnd.choice("abcdehinorst") for _ in range(9000))]
    return mixed + long


def test_encode_like_the_library(library):
    coder = byte_bpe.ByteBpe(RANKS, P.PATTERN)
    for text in odd_texts():
        assert np.frombuffer(coder.encode(text), np.int32).tolist() == library.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="thean singo", max_size=120), st.integers(0, 120))
def test_join_is_the_whole(text, at):
    merger = byte_bpe.coder(RANKS, P.PATTERN).merger
    data = text.encode()
    left, right = (merger.direct(merger.symbols(d)) for d in (data[:at], data[at:]))
    assert merger.join(left, right) == merger.direct(merger.symbols(data))


def test_memo_forgets_but_answers():
    memo = bpe.Memo(lambda x: x * 2, limit=10)
    assert [memo[i % 37] for i in range(500)] == [2 * (i % 37) for i in range(500)]
    assert len(memo) <= 10 and len(memo.old) <= 10


def test_rows(documents, library):
    out = byte_bpe.decode(byte_bpe.encode(documents, RANKS, P.PATTERN), RANKS, P.PATTERN)
    texts = {r.doc_id: r.text for r in documents.collect()}
    rows = out.collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.ids == library.encode_ordinary(texts[r.doc_id])
        assert bytes(r.decoded).decode() == texts[r.doc_id]


def test_odd_rows(odd, no_docs, library):
    docs = odd("ids")
    out = byte_bpe.decode(byte_bpe.encode(docs, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    want = [(i, library.encode_ordinary(t or "")) for i, t, _ in ODD]
    assert sorted(((r.doc_id, r.ids) for r in out), key=repr) == sorted(want, key=repr)
    assert all(bytes(r.decoded) == library.decode_bytes(r.ids) for r in out)
    assert byte_bpe.encode(no_docs, RANKS, P.PATTERN).count() == 0


def test_decode_null_and_unknown(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [262, 262])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in byte_bpe.decode(rows, RANKS, P.PATTERN).collect()}
    assert got[1] is None and got[2] == b"" and len(got[3]) > 0
    bad = spark.createDataFrame([(1, [10 ** 6])], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="not in the rank file"):
        byte_bpe.decode(bad, RANKS, P.PATTERN).collect()


def test_counts_like_the_library(tokenizer):
    counter = token_counts.counter(COUNTS)
    for text in odd_texts():
        assert counter.count(text) == len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_proved_strings_are_one_token(tokenizer):
    vocab = [t for t in tokenizer.get_vocab() if t != "<|endoftext|>"]
    back = {c: bytes([b]) for b, c in enumerate(bpe.byte_letters())}
    whole = {b"".join(back[c] for c in t) for t in vocab}
    assert token_counts.counter(COUNTS).single <= whole


def test_count_rows(documents, odd, no_docs, tokenizer):
    for docs in (documents, odd("n_tokens")):
        got = [tuple(r) for r in token_counts.count_tokens(docs, COUNTS, 512).collect()]
        want = []
        for doc, text in docs.select("doc_id", "text").collect():
            n = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
            want.append((doc, len((text or "").encode()), n, n > 512))
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert token_counts.count_tokens(no_docs, COUNTS, 512).count() == 0
