import json
import os

import pytest

from cohortloom import schemas
from cohortloom.operators import ingest
from cohortloom.plans import nightly
from cohortloom.sources import files


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


V2 = ("Chr\tName\tMValue\tStart_hg38\tEPICv1_Loci\tBeta\n"
      "1\ta1\t1.0\t5\tA\t0.1\n1\ta2\t3.0\t5\tA\t0.3\n1\tb1\tNA\t5\tB\t0.5\n1\tz\t9\t5\tNA\t0.9\n")
V1 = "Name\tBeta\tMValue\nA\t0.4\t2.5\nC\tNA\tInf\n"


@pytest.fixture
def raw(tmp_path):
    write(str(tmp_path / "raw/x/P1_7_T_M_methylation_anno_hg38.txt"), V2)
    write(str(tmp_path / "raw/P2_8_T_M_methylation_anno_hg38.txt"), V1)
    write(str(tmp_path / "raw/P3_9_T_M_methylation_anno_hg38.txt"), "Name\tOther\nA\t1\n")
    write(str(tmp_path / "raw/P4_1_T_M_methylation_anno_hg38.txt"), "")
    write(str(tmp_path / "raw/x/y/notes.csv"), "a,b\n")
    return str(tmp_path / "raw")


@pytest.fixture
def manifest(frame):
    return frame([("a1", "A", "Superior probe"), ("a2", "A", "Superior probe"),
                  ("b1", "B", None), ("b2", "B", None)],
                 "IlmnID string, EPICv1locmatch string, Rep_results_by_NAME string")


def test_listing(spark, raw):
    found = files.list_files(spark, raw, [".csv", "_methylation_anno_hg38.txt"]).collect()
    # Spark lists no empty files.
    assert len(found) == 4
    named = ingest.name_files(files.list_files(spark, raw, nightly.RAW_SUFFIXES),
                              nightly.RAW_SUFFIXES)
    assert {r.meth_sample_id for r in named.collect()} == {
        "P1_7_T_M", "P2_8_T_M", "P3_9_T_M"}


def test_arrays_of_both_versions(spark, raw, rows):
    got = files.read_arrays(spark, raw, nightly.RAW_SUFFIXES).drop("path")
    assert rows(got) == sorted([
        ("a1", "A", True, 1.0, 0.1), ("a2", "A", True, 3.0, 0.3), ("b1", "B", True, None, 0.5),
        ("z", None, True, 9.0, 0.9), ("A", None, False, 2.5, 0.4), ("C", None, False, None, None),
    ], key=repr)


def test_nightly_job_takes_each_file_once(spark, raw, manifest, tmp_path, rows):
    target = str(tmp_path / "measurements")
    taken = nightly.extract_new(spark, raw, manifest, target, "freeze0525")
    assert taken.count() == 3
    got = spark.read.parquet(target)
    assert rows(got.select("meth_sample_id", "probe_id", "m_value", "beta_value")) == [
        ("P1_7_T_M", "A", 2.0, 0.2), ("P1_7_T_M", "B", None, 0.5),
        ("P2_8_T_M", "A", 2.5, 0.4), ("P2_8_T_M", "C", None, None)]
    assert {r.freeze for r in got.collect()} == {"freeze0525"}
    again = nightly.extract_new(spark, raw, manifest, target, "freeze0525")
    # Only the file that gave no rows is looked at again.
    assert again.count() == 1 and spark.read.parquet(target).count() == 4


def test_nightly_job_fills_both_outputs(spark, raw, manifest, tmp_path, rows):
    """M and Beta values go apart, one file a turn; what only one output lacks is added there."""
    one, m, beta = (str(tmp_path / n) for n in ("one", "m", "beta"))
    nightly.extract_new(spark, raw, manifest, one, "f1")
    taken = nightly.extract_new(spark, raw, manifest, m, "f1", beta_target=beta, batch=1)
    assert taken.count() == 3
    whole = spark.read.parquet(one)
    for path, value in ((m, "m_value"), (beta, "beta_value")):
        got = spark.read.parquet(path)
        assert value in got.columns and len({"m_value", "beta_value"} & set(got.columns)) == 1
        assert rows(got.select("meth_sample_id", "probe_id", value)) == rows(
            whole.select("meth_sample_id", "probe_id", value))
    fresh = str(tmp_path / "beta2")
    again = nightly.extract_new(spark, raw, manifest, m, "f2", beta_target=fresh)
    assert again.count() == 3
    assert spark.read.parquet(fresh).count() == whole.count()
    assert {r.freeze for r in spark.read.parquet(m).select("freeze").distinct().collect()} == {"f1"}


def test_missing_features_by_slices(frame, rows, monkeypatch):
    new = frame([(f"s{i}", f"p{j}") for i in range(6) for j in range(40) if (i * j) % 3], "sample_id string, probe_id string")
    new = new.unionByName(frame([("t", "unknown"), ("t", None)], "sample_id string, probe_id string"))
    features = frame([(f"p{j}",) for j in range(40)] * 2, "probe_id string")
    want = rows(ingest.missing_features(new, features))
    known = {(r.sample_id, r.probe_id) for r in new.collect()}
    assert want == sorted([(s, f"p{j}") for s in {k[0] for k in known} for j in range(40)
                           if (s, f"p{j}") not in known], key=repr)
    monkeypatch.setattr(ingest, "SLICE", 7)
    assert rows(ingest.missing_features(new, features)) == want
    assert ingest.missing_features(new, features.limit(0)).count() == 0


def test_features_are_collected(spark, frame, rows):
    cols = "sample_id string, meth_sample_id string, probe_id string, m_value double"
    matrix = frame([("s0", "m0", "A", 1.0), ("s0", "m0", "B", 2.0)], cols)
    extracted = frame([("m0", "A", 9.0), ("m1", "A", 3.0), ("m1", "X", 4.0), ("m2", "A", 5.0)],
                      "meth_sample_id string, probe_id string, m_value double")
    sample = frame([("m0", "s0", "p0"), ("m1", "s1", "p1")],
                   "meth_sample_id string, sample_id string, patient_id string")
    features = frame([("A",), ("B",)], "probe_id string")
    out, lacking = nightly.collect_features(matrix, extracted, sample, features)
    assert rows(out) == [("s0", "m0", "A", 1.0), ("s0", "m0", "B", 2.0), ("s1", "m1", "A", 3.0)]
    assert rows(lacking) == [("m1", 1, ["B"])]
    wide = ingest.serving_table(out, ["A", "B"])
    assert rows(wide) == [("s0", 1.0, 2.0), ("s1", 3.0, None)]


def test_wide_csv(spark, tmp_path, rows):
    path = str(tmp_path / "wide.csv")
    write(path, "sampleId,p1,p2\ns1,1.5,\ns2,NaN,-2\n")
    got = files.read_matrix_csv(spark, path)
    assert rows(got) == sorted([("s1", None, "p1", 1.5), ("s1", None, "p2", None),
                                ("s2", None, "p1", None), ("s2", None, "p2", -2.0)], key=repr)
    assert files.read_matrix_csv(spark, str(tmp_path / "absent.csv")) is None


def test_dimension_csv(spark, tmp_path, rows):
    path = str(tmp_path / "meta.csv")
    write(path, "chr_hg38,probe_id,gencodebasic_name,extra\nchr1,p1,NA,1\nchrX,p2,G,2\n")
    assert rows(files.read_dimension_csv(spark, path, schemas.PROBE_META)) == [
        ("p1", None, "chr1"), ("p2", "G", "chrX")]


def test_json_and_parameters(spark, tmp_path):
    write(str(tmp_path / "p/model-ALL.json"), json.dumps(
        {"model_module": "x", "model_type": "RandomForestClassifier",
         "parameters": {"n_estimators": 5, "max_depth": None}, "feature_names": ["a", "b"]}))
    row = files.read_model_params(spark, str(tmp_path / "p")).first()
    assert row.model_name == "ALL" and row.parameters["n_estimators"] == "5"
    assert row.feature_names == ["a", "b"]
    assert files.read_json(spark, str(tmp_path / "no.json"), schemas.BOOKS) is None


def test_tables_and_base_selection(spark, frame, tmp_path):
    cols = "biosample_id string, analysis_set_id string"
    frame([("b", "a")], cols).write.parquet(str(tmp_path / "xref.parquet"))
    assert files.read_table(spark, "xref", str(tmp_path)).first().biosample_id == "b"
    frozen, updated = str(tmp_path / "frozen"), str(tmp_path / "updated")
    frame([("f", "")], cols).write.parquet(frozen)
    assert files.select_base(spark, updated, frozen).first().biosample_id == "f"
    frame([("u", "")], cols).write.parquet(updated)
    assert files.select_base(spark, updated, frozen).first().biosample_id == "u"


def test_sample_files(spark, frame, tmp_path):
    m = frame([("m1", "A", 1.0), ("m1", "B", None), ("m2", "A", 2.0)],
              "meth_sample_id string, probe_id string, m_value double")
    path = str(tmp_path / "out")
    files.write_sample_files(m, path, "m_value")
    back = spark.read.option("header", True).csv(path)
    assert {(r.meth_sample_id, r.probeName, r.m_value) for r in back.collect()} == {
        ("m1", "A", "1.0"), ("m2", "A", "2.0")}


def test_append_reads_written_ids(frame, rows):
    """The matrix's own joins are not done again beside the search for new samples."""
    cells = "meth_sample_id long, probe_id string, m_value double"
    all_cells = frame([(1, "a", 1.0), (2, "a", 2.0), (2, "b", 3.0), (None, "a", 4.0), (2, "a", 2.0)], cells)
    matrix = all_cells.join(frame([(1,)], "meth_sample_id long"), "meth_sample_id", "left_semi")
    got = ingest.append_samples(matrix, all_cells, frame([("a",)], "probe_id string"))
    assert rows(got) == sorted([(1, "a", 1.0), (2, "a", 2.0), (2, "a", 2.0), (None, "a", 4.0)], key=repr)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 3
