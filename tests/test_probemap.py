from cohortloom.operators import probemap as pm

MANIFEST = "IlmnID string, EPICv1locmatch string, Rep_results_by_NAME string"
RAW = "sample_id string, Name string, EPICv1_Loci string, MValue double, Beta double"


def manifest(frame):
    return frame([
        ("a1", "A", "Superior probe"), ("a2", "A", "Best precision by WGBS"),
        ("b1", "B", "Best precision by WGBS"), ("b2", "B", "Best sensitivity"), ("b3", "B", None),
        ("c1", "C", "Inferior precision"), ("c2", "C", None),
        ("d1", "D", "Superior probe"),
        *[(f"e{i}", "E", "Superior probe") for i in range(7)],
        ("f1", None, "Superior probe"), ("f2", None, "Superior probe")], MANIFEST)


def test_choice_of_probes(frame, rows):
    m = manifest(frame)
    assert rows(pm.probe_map(m)) == [("A", "a1"), ("B", "b1"), ("B", "b2")]
    assert rows(pm.unresolved(m)) == [("C", "c1"), ("C", "c2")]
    assert rows(pm.probe_lists(pm.probe_map(m))) == [("A", ["a1"]), ("B", ["b1", "b2"])]
    assert (None, 0) in rows(pm.replicate_counts(m))
    assert (7, 1) in rows(pm.replicate_histogram(m))
    assert pm.shared_probes(pm.probe_map(m)).count() == 0


def row_loop(raw, chosen, measure):
    """The rule applied locus by locus to one sample after another."""
    out = []
    for sample in sorted({r[0] for r in raw}):
        mine = [list(r) for r in raw if r[0] == sample and r[2] is not None]
        for locus, ids in chosen.items():
            hit = [r[measure] for r in mine if r[1] in ids]
            if hit:
                some = [v for v in hit if v is not None]
                mean = sum(some) / len(some) if some else None
                for r in mine:
                    if r[2] == locus:
                        r[measure] = mean
        left = {(r[2], r[measure]) for r in mine}
        loci = [x[0] for x in left]
        out += [(sample, p, v) for p, v in left if loci.count(p) == 1]
    return sorted(out, key=repr)


def test_collapse_equals_the_row_loop(frame, rows):
    raw = [
        ("s1", "a1", "A", 1.0, 0.1), ("s1", "a2", "A", 3.0, 0.3),
        ("s1", "b1", "B", 2.0, None), ("s1", "b2", "B", 4.0, None), ("s1", "b3", "B", 9.0, 0.5),
        ("s1", "c1", "C", 5.0, 0.5), ("s1", "c2", "C", 6.0, 0.5),
        ("s1", "d1", "D", 7.0, 0.7), ("s1", "z", None, 8.0, 0.8),
        ("s2", "a2", "A", 3.0, 0.3), ("s2", "b3", "B", 1.0, 0.2),
        ("s2", "c1", "C", None, 0.1), ("s2", "c2", "C", 2.0, 0.1),
        ("s2", "g1", "G", None, 0.1), ("s2", "g2", "G", None, None)]
    out = pm.collapse(frame(raw, RAW), pm.probe_map(manifest(frame)))
    chosen = {"A": {"a1"}, "B": {"b1", "b2"}}
    for measure, at in (("MValue", 3), ("Beta", 4)):
        assert rows(pm.collapsed_measure(out, measure)) == row_loop(raw, chosen, at)


def test_first_row_wins_in_file_order(frame, rows):
    raw = frame([("s", "x", "A", None, 2), ("s", "y", "A", 5.0, 3), ("s", "z", "B", 1.0, 1)],
                "sample_id string, Name string, EPICv1_Loci string, MValue double, line_no int")
    assert rows(pm.first_per_locus(raw)) == [("s", "A", None), ("s", "B", 1.0)]
