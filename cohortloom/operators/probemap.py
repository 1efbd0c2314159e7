"""Mapping of the newer array's probes to the loci of the older array."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Replicate counts that get resolved, and the two labels used.
RESOLVED_COUNTS = (2, 3, 4, 5, 6, 10)
SUPERIOR = "Superior probe"
BEST = "Best"


def replicate_counts(manifest: DataFrame) -> DataFrame:
    """Probes per locus; probes without a locus fall in no group."""
    return manifest.groupBy("EPICv1locmatch").agg(
        F.count("EPICv1locmatch").alias("n_replicates"))


def replicate_histogram(manifest: DataFrame) -> DataFrame:
    return replicate_counts(manifest).groupBy("n_replicates").agg(
        F.count("EPICv1locmatch").alias("n_loci"))


def _candidates(manifest: DataFrame, counts) -> DataFrame:
    """Manifest rows of loci whose replicate count is resolved, with a rank."""
    rows = manifest.filter(F.col("EPICv1locmatch").isNotNull())
    loci = replicate_counts(rows).filter(F.col("n_replicates").isin(*counts)).select(
        "EPICv1locmatch")
    label = F.col("Rep_results_by_NAME")
    rank = F.when(label == SUPERIOR, 1).when(label.contains(BEST), 2)
    return rows.join(loci, "EPICv1locmatch", "left_semi").select(
        "EPICv1locmatch", "IlmnID", rank.alias("rank"))


def probe_map(manifest: DataFrame, counts=RESOLVED_COUNTS) -> DataFrame:
    """Chosen probes, one row per (locus, probe).

    Superior probes win; without any, those whose label contains "Best".
    """
    rows = _candidates(manifest, counts)
    best = rows.groupBy("EPICv1locmatch").agg(F.min("rank").alias("rank"))
    return rows.join(best, ["EPICv1locmatch", "rank"]).select("EPICv1locmatch", "IlmnID")


def probe_lists(chosen: DataFrame) -> DataFrame:
    """The map as one sorted list per locus; at most ten probes each."""
    return chosen.groupBy("EPICv1locmatch").agg(
        F.sort_array(F.collect_list("IlmnID")).alias("IlmnID"))


def unresolved(manifest: DataFrame, counts=RESOLVED_COUNTS) -> DataFrame:
    """Manifest rows of replicated loci with neither kind of label."""
    rows = _candidates(manifest, counts)
    hopeless = rows.groupBy("EPICv1locmatch").agg(F.min("rank").alias("rank")).filter(
        F.col("rank").isNull()).select("EPICv1locmatch")
    return rows.join(hopeless, "EPICv1locmatch", "left_semi").select(
        "EPICv1locmatch", "IlmnID")


def shared_probes(chosen: DataFrame) -> DataFrame:
    """Probes listed under more than one locus; must be empty on ingest."""
    return chosen.groupBy("IlmnID").agg(F.count(F.lit(1)).alias("n_loci")).filter("n_loci > 1")


def collapse(raw: DataFrame, chosen: DataFrame, measures=("MValue", "Beta")) -> DataFrame:
    """One value per (sample, locus) and measure.

    A locus with at least one chosen probe in the sample takes the mean of its
    chosen probes.  Any other locus keeps its value when all its rows agree and
    is dropped for that measure when they do not (a null disagrees with a number).

    ``raw`` holds (sample_id, Name, EPICv1_Loci, <measures>).  A row counts for
    its own locus and, if its probe was chosen, towards the mean of the locus the
    map names for it, which is nearly always the same one.  So the rows are read
    and shuffled once, already combined per task.
    Returned columns: sample_id, probe_id, <measure>, <measure>_kept.
    """
    rows = raw.filter(F.col("EPICv1_Loci").isNotNull())
    own, target = F.col("EPICv1_Loci"), F.col("EPICv1locmatch")
    counts = lambda locus, base, picked: F.struct(
        locus.alias("probe_id"), F.lit(base).alias("base"), picked.alias("picked"))
    shares = F.when(target.isNull() | (target == own), F.array(
        counts(own, True, target.isNotNull()))).otherwise(F.array(
            counts(own, True, F.lit(False)), counts(target, False, F.lit(True))))
    spread = rows.join(chosen, rows["Name"] == chosen["IlmnID"], "left").select(
        "sample_id", *measures, F.inline(shares))
    base = F.col("base")
    both = spread.groupBy("sample_id", "probe_id").agg(
        F.count_if(base).alias("n"), F.max("picked").alias("mapped"),
        *[x for c in measures for x in (
            F.count(F.when(base, F.col(c))).alias(f"{c}_n"),
            F.min(F.when(base, F.col(c))).alias(f"{c}_lo"),
            F.max(F.when(base, F.col(c))).alias(f"{c}_hi"),
            F.avg(F.when(F.col("picked"), F.col(c))).alias(f"{c}_mean"))]).filter("n > 0")
    mapped = F.col("mapped")
    out = [F.col("sample_id"), F.col("probe_id")]
    for c in measures:
        agrees = (F.col(f"{c}_n") == 0) | (
            (F.col(f"{c}_n") == F.col("n")) & (F.col(f"{c}_lo") == F.col(f"{c}_hi")))
        kept = mapped | agrees
        value = F.when(mapped, F.col(f"{c}_mean")).when(agrees, F.col(f"{c}_lo"))
        out += [value.alias(c), kept.alias(f"{c}_kept")]
    any_kept = None
    for c in measures:
        any_kept = F.col(f"{c}_kept") if any_kept is None else any_kept | F.col(f"{c}_kept")
    return both.select(*out).filter(any_kept)


def collapsed_measure(collapsed: DataFrame, measure: str) -> DataFrame:
    """The rows of :func:`collapse` that survive for one measure."""
    return collapsed.filter(F.col(f"{measure}_kept")).select(
        "sample_id", "probe_id", measure)


def to_measurements(collapsed: DataFrame) -> DataFrame:
    """Both measures side by side, as rows of the measurements table."""
    return collapsed.select(
        F.col("sample_id").alias("meth_sample_id"), "probe_id",
        F.col("MValue").alias("m_value"), F.col("Beta").alias("beta_value"))


def pass_through(raw_v1: DataFrame) -> DataFrame:
    """Older-array files already carry locus names."""
    return raw_v1.select(
        F.col("sample_id").alias("meth_sample_id"), F.col("Name").alias("probe_id"),
        F.col("MValue").alias("m_value"), F.col("Beta").alias("beta_value"))


def first_per_locus(raw: DataFrame, order_by: str = "line_no") -> DataFrame:
    """Value of the first row of each (sample, locus) in file order."""
    rows = raw.filter(F.col("EPICv1_Loci").isNotNull())
    return rows.groupBy("sample_id", F.col("EPICv1_Loci").alias("probe_id")).agg(
        F.min_by(F.struct("MValue"), order_by)["MValue"].alias("m_value"))
