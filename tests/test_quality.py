from cohortloom.operators import qc

M = "sample_id string, probe_id string, m_value double"
NAN = float("nan")


def matrix(frame):
    return frame([("s1", "a", 1.0), ("s1", "b", None), ("s1", "x", 1.0), ("s1", None, 5.0),
                  ("s2", "a", 2.0), ("s2", "b", None), ("s2", "c", None), ("s2", "n", 0.0),
                  ("s3", "a", 3.0), ("s3", "c", 3.0)], M)


def dims(frame):
    meta = frame([("a", "G1", "chr1"), ("b", "G2", "chr2"), ("c", "G3", "chr3"),
                  ("x", "G4", "chrX"), ("n", None, "chr1")],
                 "probe_id string, gencodebasic_name string, chr_hg38 string")
    bad = frame([("b", "Polymorphism"), ("c", "CrossHybridization")],
                "probe_id string, reason string")
    return meta, bad


def test_membership_drops_null_probes(frame, rows):
    meta, _ = dims(frame)
    m = matrix(frame)
    assert {r[0] for r in rows(qc.keep_probes(m, qc.gene_probes(meta)))} == {"a", "b", "c", "x"}
    assert {r[0] for r in rows(qc.drop_probes(m, qc.chromosome_probes(meta)))} == \
        {"a", "b", "c", "n"}
    long = qc.filter_long(m, qc.chromosome_probes(meta), qc.gene_probes(meta))
    assert {r[0] for r in rows(long)} == {"a", "b", "c"}


def test_sample_threshold_is_inclusive(frame):
    m = matrix(frame)
    kept = lambda n: {r.sample_id for r in qc.drop_sparse_samples(m, n).collect()}
    assert kept(0) == {"s3"}
    assert kept(1) == {"s1", "s3"}
    assert kept(2) == {"s1", "s2", "s3"}
    gaps = {r.sample_id: r.n_missing for r in qc.missing_per_sample(m, True).collect()}
    assert gaps["s3"] == 3


def test_absent_rows_make_a_probe_incomplete(frame):
    m = matrix(frame).filter("probe_id is not null")
    assert [r.probe_id for r in qc.complete_probes(m).collect()] == ["a"]
    full = frame([("s1", "a", 1.0), ("s1", "b", 1.0), ("s2", "a", 1.0)], M)
    assert [r.sample_id for r in qc.complete_samples(full).collect()] == ["s1"]


def test_report_agrees_with_the_steps(frame, rows):
    meta, bad = dims(frame)
    m = matrix(frame).filter("probe_id is not null")
    report = {r.step: r for r in qc.qc_report(m, meta, bad, 1).collect()}
    steps = [m]
    steps.append(qc.keep_probes(steps[-1], qc.gene_probes(meta)))
    steps.append(qc.drop_probes(steps[-1], qc.chromosome_probes(meta)))
    steps.append(qc.drop_sparse_samples(steps[-1], 1))
    steps.append(qc.drop_probes(steps[-1], qc.blacklisted(bad, qc.SNP_ADJACENT)))
    steps.append(qc.drop_probes(steps[-1], qc.blacklisted(bad, qc.CROSS_HYBRIDISING)))
    for i in range(5):
        want = qc.step_shape("x", steps[i], steps[i + 1]).first()
        got = report[i + 1]
        for column in ("samples_before", "samples_after", "probes_before", "probes_after"):
            assert got[column] == want[column], (i, column)
    assert rows(qc.filter_cohort(m, meta, bad, 1)) == rows(steps[-1])


def test_write_counts_while_writing(frame, spark, tmp_path):
    meta, _ = dims(frame)
    for kind in ("parquet", "csv"):
        path = str(tmp_path / kind)
        n = qc.write_filtered(matrix(frame), qc.chromosome_probes(meta), qc.gene_probes(meta),
                              path, kind)
        assert n == 7
        back = spark.read.parquet(path) if kind == "parquet" else spark.read.csv(path, header=True)
        assert back.count() == 7
