from cohortloom.operators import clinical as cl


def tables(frame):
    xref = frame([("w1", "A"), ("m1", "A"), ("w2", "B"), ("m2", "B"), ("m3", "B"), ("w3", "C")],
                 "biosample_id string, analysis_set_id string")
    bio = frame([(b, "p", 1, "wgs" if b[0] == "w" else "methylation",
                  "germline" if b == "w3" else "tumour", "dna")
                 for b in ("w1", "m1", "w2", "m2", "m3", "w3")],
                "biosample_id string, patient_id string, public_subject_id long, "
                "sample_type string, biosample_status string, biosample_type string")
    purity = frame([(1, "A", 0.3), (2, "B", 0.2), (3, "B", 0.31), (4, "C", 0.9)],
                   "purity_id long, analysis_set_id string, purity double")
    return xref, bio, purity


def test_purity_floor_is_strict(frame, rows):
    xref, bio, purity = tables(frame)
    found = cl.purity_of(xref, bio, purity)
    assert rows(found.select("biosample_id", "purity")) == [("w1", 0.3), ("w2", 0.2), ("w2", 0.31)]
    held = frame([("x", "w1"), ("x", "w2")], "disease_name string, sample_id string")
    assert [r.sample_id for r in cl.pure_samples(held, found).collect()] == ["w2"]


def test_conversion(frame, rows):
    xref, bio, _ = tables(frame)
    assert rows(cl.convert_ids(xref, bio, "wgs", "methylation")) == [
        ("w1", "m1"), ("w2", "m2"), ("w2", "m3")]
    ids = frame([("w2",)], "id string")
    assert rows(cl.convert_ids(xref, bio, "wgs", "methylation", ids)) == [
        ("w2", "m2"), ("w2", "m3")]
    asked = frame([("w2",), ("m2",)], "id string")
    assert rows(cl.methylation_siblings(xref, bio, asked)) == [("m2", "B", 2), ("m3", "B", 2)]


def test_empty_projection_keeps_columns(frame):
    sample = frame([("s", "p", "d")], "sample_id string, patient_id string, diagnosis string")
    none = frame([("zz",)], "id string")
    out = cl.project(sample, ["sample_id", "diagnosis"], none)
    assert out.columns == ["sample_id", "diagnosis"] and out.count() == 0


def test_pivot_takes_first_known(frame, rows):
    calls = frame([("s1", "k", "v1", 2, "late"), ("s1", "k", "v1", 1, None),
                   ("s1", "k", "v1", 3, "later"), ("s2", "j", "v2", 1, "x")],
                  "sample_id string, name string, version string, at int, call string")
    out = cl.classifier_pivot(calls, ["call"], "at")
    assert out.columns == ["sample_id", "call_j_v2", "call_k_v1"]
    assert rows(out) == [("s1", "-", "late"), ("s2", "x", "-")]
