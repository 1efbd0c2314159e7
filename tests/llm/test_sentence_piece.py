"""Piece coding against the library; odd rows; the registered query."""

import hashlib
import random

import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece

import __spark_entry__ as entry
from cohortloom.llm import sentence_piece
from fixtures_llm import documents, no_docs, odd  # noqa: F401

PATH = P.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def coder():
    return sentence_piece.PieceCoder(PATH)


def ids_of(coder, text):
    return sentence_piece.array("i", coder.encode(text)).tolist()


def test_random_texts_and_ids(coder, library):
    draw = random.Random(5)
    letters = "aab  ▁▁\n\tétheing梦👍0123<s>�\x00ñ#​Ж"
    for _ in range(4000):
        text = "".join(draw.choice(letters) for _ in range(draw.randrange(14)))
        assert ids_of(coder, text) == library.encode(text), text
    pool = [0, 1, 2, *range(3, 259), *[259] * 30, 260, 261, 29871, *range(300, 330)]
    many = [[draw.choice(pool) for _ in range(draw.randrange(8))] for _ in range(8000)]
    for ids in many:
        assert coder.decode(ids) == library.decode(ids), ids
    lists = pa.array([None, *many, None, []], pa.list_(pa.int32()))
    assert coder.decode_all(lists) == [None, *map(library.decode, many), None, ""]
    assert coder.decode_all(lists.slice(5, 90)) == [library.decode(ids) for ids in many[4:94]]
    assert coder.decode_all(lists.slice(0, 0)) == [] and coder.decode_all(lists.slice(0, 1)) == [None]
    with pytest.raises(ValueError, match="not in the model"):
        coder.decode_all(pa.array([[32000]], pa.list_(pa.int32())))


def test_long_runs_without_spaces(coder, library):
    for text in ("a" * 50_000, "wordand" * 5000, "ab" * 4000 + "梦" * 500, " " * 20_000, "=-" * 3000, "x\n" * 9000):
        assert ids_of(coder, text) == library.encode(text)


def test_walk_goes_back_and_marks_places(coder):
    """The walk gives what merging gives, also where the longest piece is wrong."""
    draw, wrong = random.Random(6), 0
    for _ in range(3000):
        text = "".join(draw.choice("eirstnhoalcdu") for _ in range(draw.randrange(1, 24)))
        want = coder.merger.direct(text)
        assert coder.walk(text) == want
        at, greedy = 0, []
        while at < len(text):
            greedy.append(next(text[at:at + n] for n in range(16, 0, -1) if text[at:at + n] in coder.ids))
            at += len(greedy[-1])
        wrong += greedy != want
    assert wrong > 1000


def test_runs_are_never_joined(coder):
    """No piece holds two neighbours of different runs."""
    for piece in coder.merger.rank:
        assert len(coder.runs.findall(piece)) == 1, piece


def test_odd_rows(odd, no_docs, library):
    docs = odd("ids")
    out = sentence_piece.decode(sentence_piece.encode(docs, PATH), PATH).collect()
    want = [(r.doc_id, r.text or "") for r in docs.collect()]
    assert sorted(((r.doc_id, r.ids, r.decoded) for r in out), key=repr) == sorted(
        ((i, library.encode(t) + [2], library.decode(library.encode(t))) for i, t in want), key=repr)
    assert sentence_piece.decode(sentence_piece.encode(no_docs, PATH), PATH).count() == 0


def test_null_ids(spark):
    rows = spark.createDataFrame([(1, None, "a"), (2, [], "b")], "x int, ids array<int>, decoded string")
    out = sentence_piece.decode(rows, PATH)
    assert out.columns == ["x", "ids", "decoded"]
    assert {r.x: r.decoded for r in out.collect()} == {1: None, 2: ""}


def test_query(spark, library, documents):
    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    got = {tuple(r) for r in entry.queries()["op12_sentence_piece"](spark, SF).collect()}
    want = set()
    for r in documents.collect():
        ids = library.encode(r.text or "") + [2]
        want.add((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    assert got == want
