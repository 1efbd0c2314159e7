import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohortloom.operators import dataset as ds, qc, tree
from cohortloom.operators.ranking import hash_rank, running

M = "sample_id string, probe_id string, m_value double"


def small_tree(frame, groups):
    """A root with one child per group; groups maps a name to its sample ids."""
    edges = frame([("root", name, i) for i, name in enumerate(groups)],
                  "parent string, child string, position int")
    held = frame([(n, s) for n, some in groups.items() for s in some],
                 "disease_name string, sample_id string")
    nodes = tree.build_tree(edges, held, "root")
    return nodes, tree.node_samples(nodes, held)


def long_matrix(frame, ids, features, gaps=()):
    return frame([(s, f, None if (s, f) in gaps else float(i * 10 + j))
                  for i, s in enumerate(ids) for j, f in enumerate(features)], M)


IDS = [f"s{i}" for i in range(10)]


def test_basic_design(frame):
    nodes, held = small_tree(frame, {"typeA": IDS[:5], "typeB": IDS[5:]})
    m = long_matrix(frame, IDS, ["feature1", "feature2"])
    design = ds.node_design(m, nodes, held).collect()
    assert Counter(r.cancer_type for r in design) == {"typeA": 5, "typeB": 5}


def test_null_column_is_dropped(frame):
    nodes, held = small_tree(frame, {"typeA": IDS[:5], "typeB": IDS[5:]})
    m = long_matrix(frame, IDS, ["feature1", "feature2", "feature3"], {("s4", "feature2")})
    long = ds.node_matrix(qc.drop_incomplete_probes(m), ds.node_design(m, nodes, held))
    assert {r.probe_id for r in long.collect()} == {"feature1", "feature3"}
    assert long.count() == 20
    other = ds.cohort_design(m, nodes, held)
    assert {r.probe_id for r in ds.cohort_probes(m, other).collect()} == {"feature1", "feature3"}
    assert ds.drop_gappy_samples(m, other).count() == 9


@pytest.mark.parametrize("groups", [
    {"typeA": ["s0"], "typeB": ["s1"]},
    {"typeA": IDS[:4]},
    {"typeA": IDS[:5], "typeB": IDS[5:9]},
    {"typeA": IDS[:8], "typeB": IDS[8:]},
])
def test_guards_leave_no_design(frame, groups):
    nodes, held = small_tree(frame, groups)
    assert ds.node_design(long_matrix(frame, IDS, ["f"]), nodes, held).count() == 0


def test_unlabelled_samples_and_overlap(frame):
    nodes, held = small_tree(frame, {"a": IDS[:6], "b": IDS[4:], "tiny": ["t1", "t2"]})
    m = long_matrix(frame, IDS + ["t1", "t2", "stranger"], ["f"])
    labels = {r.sample_id: r.cancer_type for r in ds.node_design(m, nodes, held).collect()}
    assert len(labels) == 10 and labels["s4"] == "b" and labels["s3"] == "a"
    other = {r.sample_id: r.cancer_type for r in ds.cohort_design(m, nodes, held).collect()
             if r.node_id == "root"}
    assert other["t1"] == ds.OTHER and "stranger" not in other


def test_leaf_split_sizes(frame):
    nodes, held = small_tree(frame, {"a": IDS, "b": ["x"], "c": ["y1", "y2", "y3"]})
    got = Counter((r.node_id, r.split) for r in ds.split_leafwise(nodes, held).collect())
    assert got == {("root/a", "validation"): 2, ("root/a", "training"): 8,
                   ("root/b", "validation"): 1, ("root/c", "validation"): 1,
                   ("root/c", "training"): 2}
    rolled = ds.roll_up(nodes, ds.split_leafwise(nodes, held)).filter("node_id = 'root'")
    assert Counter(r.split for r in rolled.collect()) == {"validation": 4, "training": 10}


def test_stratified_split(frame):
    many = [f"m{i}" for i in range(33)]
    nodes, held = small_tree(frame, {"a": many, "b": IDS, "single": ["z"]})
    got = Counter(r.label for r in ds.split_stratified(nodes, held).collect())
    # ceil(0.2 * 43) = 9: shares 6.9 and 2.1.
    assert got == {"a": 7, "b": 2}


def test_random_split_and_folds(spark):
    df = spark.range(101).select(F.col("id").alias("sample_id"), (F.col("id") % 7).alias("label"))
    split = ds.split_random(df)
    assert split.filter("held_out").count() == math.ceil(20.2)
    again = {r.sample_id for r in ds.split_random(df.repartition(5)).filter("held_out").collect()}
    assert again == {r.sample_id for r in split.filter("held_out").collect()}
    folds = ds.assign_folds(df, "label", 3)
    assert sorted(r["count"] for r in folds.groupBy("fold").count().collect()) == [33, 34, 34]
    for r in folds.groupBy("label", "fold").count().collect():
        assert 4 <= r["count"] <= 6


def test_split_per_key(spark):
    df = spark.range(60).select(F.col("id").alias("sample_id"),
                                F.when(F.col("id") < 40, "n1").otherwise("n2").alias("node_id"))
    got = ds.split_random(df, keys=("node_id",)).filter("held_out").groupBy("node_id").count()
    assert {r.node_id: r["count"] for r in got.collect()} == {"n1": 8, "n2": 4}
    folds = ds.assign_folds(df.withColumn("l", F.lit("x")), "l", 2, keys=("node_id",))
    assert {(r.node_id, r.fold): r["count"] for r in folds.groupBy("node_id", "fold").count()
            .collect()} == {("n1", 0): 20, ("n1", 1): 20, ("n2", 0): 10, ("n2", 1): 10}


def test_rank_in_buckets_equals_the_window(spark):
    """One key holds most rows, and half the rows share one shuffling number."""
    df = spark.range(3000).select(
        F.col("id").alias("sample_id"),
        F.when(F.col("id") % 10 == 0, F.col("id") % 70).otherwise(1).alias("k"))
    unit = F.when(F.col("sample_id") % 2 == 0, 0.5).otherwise(F.col("sample_id") * 37 % 1000 / 1000)
    got = {r.sample_id: r["rank"] for r in hash_rank(df, ["k"], unit, "sample_id").collect()}
    plain = df.withColumn("u", unit).selectExpr(
        "sample_id", "row_number() over (partition by k order by u, sample_id) as r")
    assert got == {r.sample_id: r.r for r in plain.collect()}


def test_running_sums_equal_the_window(spark):
    df = spark.range(2000).select(
        F.when(F.col("id") < 1500, "hot").otherwise("cold").alias("k"),
        (F.col("id") * F.col("id") % 7919 / 7919.0).alias("score"),
        (F.col("id") % 3).alias("n")).groupBy("k", "score").agg(F.sum("n").alias("n"))
    got = {(r.k, r.score): (r.cum_n, r.total_n, r.top_n)
           for r in running(df, ["k"], "score", ("n",), ("n",), buckets=16).collect()}
    want = df.selectExpr("k", "score", "sum(n) over (partition by k order by score desc) as c",
                         "sum(n) over (partition by k) as t",
                         "max(n) over (partition by k order by score desc) as x")
    assert got == {(r.k, r.score): (r.c, r.t, r.x) for r in want.collect()}
