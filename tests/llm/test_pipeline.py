"""Each stage of the corpus pipeline against a plain version of it; the entry points."""

import re

import numpy as np
import public_tokenizers as P
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline
from cohortloom.llm import bpe, pii, quality
from test_decontaminate import share, words
from test_pii import field, plain
from test_simhash import plain_groups

SF = "/root/testdata/sf0.001"
TABLES = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "decontamination", "personal_data", "byte_bpe"]

    good = stages["quality"](spark, docs, SF).cache()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    want = {r.doc_id for r in quality.classify(docs, labels).collect() if r.predicted}
    assert good.columns == TABLES and {r.doc_id for r in good.collect()} == want

    one = stages["near_duplicates"](spark, good, SF).cache()
    groups = plain_groups([(r.doc_id, r.text) for r in good.collect()])
    assert one.columns == TABLES
    assert sorted(r.doc_id for r in one.collect()) == sorted({c for _, _, c in groups})

    clean = stages["decontamination"](spark, one, SF).cache()
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    pieces = {w for item in items for w in zip(item, item[1:], item[2:])}  # a quick sieve before the slow test
    bad = {r.doc_id for r in one.collect() if (w := words(r.text)) and pieces & set(zip(w, w[1:], w[2:]))
           and any(share(w, i) for i in items)}
    assert clean.columns == TABLES
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in one.collect()} - bad

    private = stages["personal_data"](spark, clean, SF).cache()
    model = field([r.text for r in clean.collect()])
    before = {r.doc_id: r for r in clean.collect()}
    for r in private.collect():
        old = before[r.doc_id]
        assert r.text == pii.redacted(old.text, pii.spans_of(model, old.text)[1])
        assert r.n_chars == (len(r.text) if r.text != old.text else old.n_chars)
        assert not plain(old.text) or r.text != old.text
    assert private.columns == TABLES and private.count() == len(before)

    last = stages["byte_bpe"](spark, private, SF).collect()
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, special_tokens={},
                                mergeable_ranks=bpe.load_ranks(P.path(corpus_pipeline.RANKS)))
    texts = {r.doc_id: r.text for r in private.collect()}
    assert {r.doc_id: (r.ids, r.n_tokens, r.text) for r in last} == {
        i: (ids := library.encode_ordinary(t), len(ids), t) for i, t in texts.items()}


def test_run_gives_the_last_stage(spark):
    out = entry.queries()["pipeline"](spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids", "text"] and out.count() > 100


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_odd_documents(spark):
    rows = [(1, "one two three four five", None, "s", 23, "x"), (1, "one two three four five", None, "s", 23, "x"),
            (None, None, None, None, None, None), (2, "", "en", "s", 0, "y"), (3, "a " * 60_000, "en", "s", 1, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    good = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    assert good.columns == [*TABLES, "score"] and good.count() <= docs.count()
    for name, stage in corpus_pipeline.STAGES[1:4]:
        docs = stage(spark, docs, SF)
        assert docs.columns == [*TABLES, "score"], name
    assert {r.doc_id for r in docs.collect()} == {1, 2, 3}
    assert corpus_pipeline.STAGES[4][1](spark, docs, SF).count() == 3


def test_every_operator_is_registered():
    names = set(entry.queries())
    assert all(any(re.match(rf"op{n}_", x) for x in names) for n in range(1, 14)) and "pipeline" in names


def test_sql_of_queries(spark, con):
    from oracle import compare

    for name, sql in entry.oracle_sql().items():
        if name.startswith("op"):
            assert compare(entry.queries()[name](spark, SF), con, sql) > 0
