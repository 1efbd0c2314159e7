import pytest
from pyspark.sql import functions as F

from cohortloom.operators import probemap
from cohortloom.sources import files
from cohortloom.functions.values import base_name, id_from_file_name
from cohortloom.streaming import ingest as stream

RAW = "sample_id string, Name string, EPICv1_Loci string, MValue double, Beta double"
HEAD = "Name\tEPICv1_Loci\tMValue\tBeta\n"
SUFFIX = ["_anno.txt"]


def put(folder, sample, lines):
    (folder / f"{sample}_anno.txt").write_text(HEAD + "".join(lines))


def prepare(batch):
    return files.parse_arrays(batch).withColumn(
        "sample_id", id_from_file_name(base_name("path"), SUFFIX))


def run(spark, folder, chosen, target, progress):
    lines = spark.readStream.text(str(folder)).select(
        "value", F.col("_metadata.file_path").alias("path"))
    stream.ingest_arrays(lines, chosen, target, progress, prepare).awaitTermination()


def test_stream_equals_batch_and_is_idempotent(spark, frame, tmp_path, rows):
    folder = tmp_path / "in"
    folder.mkdir()
    target, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    chosen = frame([("A", "a1"), ("A", "a2")], "EPICv1locmatch string, IlmnID string")
    put(folder, "s1", ["a1\tA\t1.0\t0.1\n", "a2\tA\t3.0\t0.3\n", "c\tC\t5\t0.5\n"])
    put(folder, "s2", ["a3\tA\t7.0\t0.7\n"])
    run(spark, folder, chosen, target, progress)
    assert stream.current(spark, target).count() == 3
    run(spark, folder, chosen, target, progress)
    assert stream.current(spark, target).count() == 3
    put(folder, "s3", ["a1\tA\t2.0\t0.2\n"])
    run(spark, folder, chosen, target, progress)

    lines = spark.read.text(str(folder)).select(
        "value", F.col("_metadata.file_path").alias("path"))
    batch = probemap.collapse(prepare(lines), chosen)
    assert rows(stream.current(spark, target)) == rows(batch)


@pytest.mark.parametrize("files_a_batch", [1, 4])
def test_answers_do_not_hang_on_batches(spark, frame, tmp_path, rows, files_a_batch):
    """The same rows in four files, one or all of them a batch; samples span the files."""
    raw = frame([(f"s{i % 3}", f"a{i % 5}", f"L{i % 2}", float(i % 4), 0.1) for i in range(40)], RAW)
    raw.repartition(4).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(RAW).option(
        "maxFilesPerTrigger", files_a_batch).parquet(str(tmp_path / "in"))
    chosen = frame([("L0", "a1"), ("L1", "a2")], "EPICv1locmatch string, IlmnID string")
    arrays, fresh, first = (str(tmp_path / n) for n in ("arrays", "fresh", "first"))
    stream.ingest_arrays(read(), chosen, arrays, arrays + "_p").awaitTermination()
    assert rows(stream.current(spark, arrays)) == rows(probemap.collapse(raw, chosen))
    known = frame([("s0",)], "sample_id string")
    stream.ingest_new_samples(read(), known, fresh, fresh + "_p", "sample_id").awaitTermination()
    assert rows(spark.read.parquet(fresh).drop("batch_id")) == rows(raw.filter("sample_id <> 's0'"))
    stream.ingest_first(read().select("sample_id"), first, first + "_p").awaitTermination()
    assert rows(spark.read.parquet(first).drop("batch_id")) == [("s0",), ("s1",), ("s2",)]


def test_a_batch_reads_only_what_its_samples_landed(frame, tmp_path, rows):
    """However many batches came before, history is opened where its samples lie."""
    landed = str(tmp_path / "raw")
    part = lambda *ids: frame([(i, "a1", "A", float(n), 0.1) for n, i in enumerate(ids)], RAW)
    for n in range(6):
        batch, touched = stream.land_rows(part(*[f"b{n}s{i}" for i in range(5)], None), n, landed)
        assert batch.count() == 5 and touched.count() == 5
        assert stream.landed_before(batch, touched, n, landed) is None
    again = part("b1s2", "b4s0", "new", "b1s2")
    for _ in range(2):  # a replay reads the same
        batch, touched = stream.land_rows(again, 6, landed)
        past = stream.landed_before(batch, touched, 6, landed)
        assert rows(past) == [("b1s2", "a1", "A", 2.0, 0.1), ("b4s0", "a1", "A", 0.0, 0.1)]
        opened = {tuple(f.split("/")[-3:-1]) for f in past.inputFiles()}
        assert {o[0] for o in opened if o[0] != "batch_id=6"} == {"batch_id=1", "batch_id=4"}
    none, nobody = stream.land_rows(part(), 7, landed)
    assert none.count() == 0 and stream.landed_before(none, nobody, 7, landed) is None


def test_replay_and_repeats(spark, frame, tmp_path):
    target = str(tmp_path / "out")
    first = frame([("s1", 1.0), ("s2", 2.0)], "sample_id string, v double")
    stream.append_once(first, 0, target)
    stream.append_once(first, 0, target)
    assert spark.read.parquet(target).count() == 2
    # A sample another batch holds is skipped; the new one is taken, also on replay.
    second = frame([("s2", 9.0), ("s3", 3.0)], "sample_id string, v double")
    for _ in range(2):
        stream.append_once(second, 1, target)
        assert {(r.sample_id, r.v) for r in spark.read.parquet(target).collect()} == {
            ("s1", 1.0), ("s2", 2.0), ("s3", 3.0)}
