"""Splits of the tree's samples and the data sets of its nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut
from . import qc, tree
from .ranking import hash_rank

# Fixed values of dataset building.
OTHER = "otherCancerType"
MIN_CLASS, MIN_SAMPLES = 3, 10
TEST_SHARE, SEED, FOLDS = 0.2, 42, 3


def shuffle_unit(key: str = "sample_id", seed: int = SEED) -> Column:
    """A reproducible number in [0, 1) per key."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 32)) / float(1 << 32)


def split_leafwise(nodes: DataFrame, samples: DataFrame, ratio: float = TEST_SHARE,
                   unit: Column | None = None) -> DataFrame:
    """Validation or training for every leaf sample: (node_id, sample_id, split).

    Each leaf gives ``max(1, floor(n * ratio))`` samples to validation.
    """
    leaf = tree.leaves(nodes, samples).select("node_id")
    ranked = hash_rank(samples.join(leaf, "node_id", "left_semi"), ["node_id"],
                       shuffle_unit() if unit is None else unit, "sample_id")
    share = F.greatest(F.lit(1), F.floor(F.col("group_size") * ratio))
    return ranked.select(
        "node_id", "sample_id",
        F.when(F.col("rank") <= share, "validation").otherwise("training").alias("split"))


def roll_up(nodes: DataFrame, split: DataFrame) -> DataFrame:
    """The leaf split seen from every node above it."""
    return tree.closure(nodes).join(
        split.withColumnRenamed("node_id", "descendant_id"), "descendant_id").select(
        F.col("ancestor_id").alias("node_id"), "sample_id", "split")


def _child_samples(nodes: DataFrame, samples: DataFrame) -> DataFrame:
    """(node_id, label, preorder, sample_id): a child's own samples, else all below it."""
    child = nodes.filter(F.col("parent_id").isNotNull()).select(
        "node_id", F.col("parent_id").alias("above"), F.col("name").alias("label"), "preorder")
    own = samples.select("node_id").distinct().withColumn("own", F.lit(True))
    below = tree.closure(nodes).join(
        samples.withColumnRenamed("node_id", "descendant_id"), "descendant_id").select(
        F.col("ancestor_id").alias("node_id"), "distance", "sample_id")
    return child.join(own, "node_id", "left").join(below, "node_id").filter(
        F.col("own").isNull() | (F.col("distance") == 0)).select(
        F.col("above").alias("node_id"), "label", "preorder", "sample_id")


def split_stratified(nodes: DataFrame, samples: DataFrame, share: float = TEST_SHARE,
                     min_per_class: int = 2, unit: Column | None = None) -> DataFrame:
    """Validation samples of each node, stratified by child: (node_id, label, sample_id).

    A sample under several children takes the last one's label, but counts for
    each.  ``ceil(share * n)`` samples are dealt to the classes in proportion, the
    rest after rounding down going to the largest remainders.
    """
    listed = _child_samples(nodes, samples)
    named = listed.groupBy("node_id", "label").agg(F.count(F.lit(1)).alias("n_listed"))
    labels = listed.groupBy("node_id", "sample_id").agg(
        F.max_by("label", "preorder").alias("label"))
    valid = cut(labels.join(named.filter(F.col("n_listed") >= min_per_class),
                            ["node_id", "label"], "left_semi"))
    sizes = valid.groupBy("node_id", "label").agg(F.count(F.lit(1)).alias("n"))
    node = Window.partitionBy("node_id")
    exact = F.col("n") * F.col("n_test") / F.col("n_all")
    quota = (sizes
             .withColumns({"n_all": F.sum("n").over(node), "classes": F.count("label").over(node)})
             .filter((F.col("classes") > 1) & (F.col("n_all") > 1))
             .withColumn("n_test", F.ceil(F.col("n_all") * share))
             .withColumns({"base": F.floor(exact), "rest": F.round(exact - F.floor(exact), 9)})
             .withColumn("spare", F.col("n_test") - F.sum("base").over(node))
             .withColumn("turn", F.row_number().over(node.orderBy(F.desc("rest"), "label")))
             .select("node_id", "label",
                     (F.col("base") + (F.col("turn") <= F.col("spare")).cast("int")).alias("quota")))
    ranked = hash_rank(valid.select("node_id", "label", "sample_id"), ["node_id", "label"],
                       shuffle_unit() if unit is None else unit, "sample_id")
    return ranked.join(quota, ["node_id", "label"]).filter(
        F.col("rank") <= F.col("quota")).select("node_id", "label", "sample_id")


def split_random(samples: DataFrame, share: float = TEST_SHARE, unit: Column | None = None,
                 keys: tuple[str, ...] = ()) -> DataFrame:
    """One unstratified split (per ``keys``): ``ceil(share * n)`` samples are held out."""
    ranked = hash_rank(samples, list(keys), shuffle_unit() if unit is None else unit, "sample_id")
    return ranked.withColumn("held_out", F.col("rank") <= F.ceil(F.col("group_size") * share)) \
        .drop("rank", "group_size")


def assign_folds(samples: DataFrame, label: str, k: int = FOLDS, unit: Column | None = None,
                 keys: tuple[str, ...] = ()) -> DataFrame:
    """Stratified folds 0..k-1 (per ``keys``).

    Samples sorted by label, then shuffled, are dealt to the folds in turn.
    """
    ranked = hash_rank(samples, [*keys, label], shuffle_unit() if unit is None else unit,
                       "sample_id")
    sizes = samples.groupBy(*keys, F.col(label).alias("_label")).agg(
        F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_label").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(c).alias(f"_{c}") for c in keys], "_label",
                          F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_at"))
    same = F.col(label) == F.col("_label")
    for c in keys:
        same = same & (F.col(c) == F.col(f"_{c}"))
    return ranked.join(starts, same).withColumn(
        "fold", F.pmod(F.col("_at") + F.col("rank") - 1, F.lit(k)).cast("int")).drop(
        "rank", "group_size", "_label", "_at", *[f"_{c}" for c in keys])


def child_labels(nodes: DataFrame, samples: DataFrame, min_class: int = MIN_CLASS) -> DataFrame:
    """(node_id, sample_id, cancer_type) for all inner nodes at once.

    Children with fewer than ``min_class`` tree samples give no label; of several
    children holding a sample the last names it.
    """
    big = tree.sample_counts(nodes, samples).filter(F.col("n_samples") >= min_class)
    child = nodes.filter(F.col("parent_id").isNotNull()).join(big, "node_id", "left_semi")
    return (child.select("node_id", "parent_id", "name", "preorder")
            .join(tree.samples_below(nodes, samples), "node_id")
            .groupBy(F.col("parent_id").alias("node_id"), "sample_id")
            .agg(F.max_by("name", "preorder").alias("cancer_type")))


def _enough(design: DataFrame, min_samples: int) -> DataFrame:
    """Nodes with enough samples and at least two classes."""
    return (design.groupBy("node_id", "cancer_type").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("node_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("classes"))
            .filter((F.col("n") >= min_samples) & (F.col("classes") >= 2))
            .select("node_id"))


def _present(m: DataFrame) -> DataFrame:
    return m.select("sample_id").distinct()


def node_design(m: DataFrame, nodes: DataFrame, samples: DataFrame,
                min_class: int = MIN_CLASS, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """Labels of every trainable node; unlabelled samples are left out.

    Pair it with :func:`qc.drop_incomplete_probes` over all samples.  A design is
    small next to the matrix and used many times, so it is written out.
    """
    design = cut(child_labels(nodes, samples, min_class).join(
        _present(m), "sample_id", "left_semi"))
    return design.join(_enough(design, min_samples), "node_id", "left_semi")


def cohort_design(m: DataFrame, nodes: DataFrame, samples: DataFrame,
                  min_class: int = MIN_CLASS, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """Like :func:`node_design`, keeping the cohort's other samples under one name."""
    cohort = tree.samples_below(nodes, samples).distinct().join(
        _present(m), "sample_id", "left_semi")
    design = cut(cohort.join(child_labels(nodes, samples, min_class),
                             ["node_id", "sample_id"], "left").withColumn(
        "cancer_type", F.coalesce("cancer_type", F.lit(OTHER))))
    return design.join(_enough(design, min_samples), "node_id", "left_semi")


def cohort_probes(m: DataFrame, design: DataFrame) -> DataFrame:
    """(node_id, probe_id): probes complete within each node's cohort."""
    sizes = design.groupBy("node_id").agg(F.count(F.lit(1)).alias("n_samples"))
    return (m.join(design.select("node_id", "sample_id"), "sample_id")
            .groupBy("node_id", "probe_id").agg(
                F.countDistinct(F.when(F.col("m_value").isNotNull(), F.col("sample_id"))).alias("n"))
            .join(sizes, "node_id")
            .filter(F.col("n") == F.col("n_samples")).select("node_id", "probe_id"))


def drop_gappy_samples(m: DataFrame, design: DataFrame) -> DataFrame:
    """The design without samples that miss any value."""
    return design.join(qc.complete_samples(m), "sample_id", "left_semi")


def node_matrix(m: DataFrame, design: DataFrame, probes: DataFrame | None = None) -> DataFrame:
    """Long matrix of every node: (node_id, cancer_type, sample_id, probe_id, m_value)."""
    long = m.select("sample_id", "probe_id", "m_value").join(design, "sample_id")
    return long if probes is None else long.join(probes, ["node_id", "probe_id"], "left_semi")
