"""What workers keep between tasks, and when they let go of it."""

import pyarrow as pa
import public_tokenizers
from cohortloom.llm import byte_bpe, common, quality

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


class Worker:
    """Stands for a table whose one task runs here."""

    def mapInArrow(self, run, schema):  # noqa: N802
        return list(run([pa.record_batch({"text": ["some words"]})]))


def test_a_worker_keeps_the_tables_of_one_module_at_a_time():
    def encode(batch):
        byte_bpe.coder(PATH, public_tokenizers.PATTERN).encode("some words")
        return batch

    def grams(batch):
        quality.grams("some words")
        return batch

    def task(step, module):
        made = lambda: step
        made.__module__ = module
        return made

    quality._memo.drop()
    byte_bpe.coder.cache_clear()
    for _ in range(2):
        common.map_slices(Worker(), task(encode, byte_bpe.__name__), "text string")
        common.map_slices(Worker(), task(encode, byte_bpe.__name__), "text string")
        assert byte_bpe.coder.cache_info().currsize == 1 and not quality._memo
        common.map_slices(Worker(), task(grams, quality.__name__), "text string")
        assert byte_bpe.coder.cache_info().currsize == 0 and len(quality._memo) == 2
    common.serve("another")
    assert not quality._memo and not quality._memo.old


def test_features_travel_as_counts():
    at, counts, words = quality._counted("one two one two")
    assert at.dtype == counts.dtype == "int32" and words == 4
    assert (quality._shares(at, counts, words)[1][:-1] * 4 == counts).all()
