"""Quality filters of probes and samples, and their audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut

# Fixed values of the filter job.
SEX_AND_MITO = ("chrX", "chrY", "chrM")
SNP_ADJACENT = "Polymorphism"
CROSS_HYBRIDISING = "CrossHybridization"
MAX_MISSING = 50000


def gene_probes(probe_meta: DataFrame) -> DataFrame:
    return probe_meta.filter(F.col("gencodebasic_name").isNotNull()).select("probe_id")


def chromosome_probes(probe_meta: DataFrame, chromosomes=SEX_AND_MITO) -> DataFrame:
    return probe_meta.filter(F.col("chr_hg38").isin(*chromosomes)).select("probe_id")


def blacklisted(blacklist: DataFrame, *reasons: str) -> DataFrame:
    return blacklist.filter(F.col("reason").isin(*reasons)).select("probe_id")


def keep_probes(m: DataFrame, probes: DataFrame) -> DataFrame:
    """Rows whose probe is listed.  A null probe is never listed."""
    return m.join(probes, "probe_id", "left_semi")


def drop_probes(m: DataFrame, probes: DataFrame) -> DataFrame:
    """Rows whose probe is known and not listed."""
    return m.filter(F.col("probe_id").isNotNull()).join(probes, "probe_id", "left_anti")


def missing_per_sample(m: DataFrame, absent_is_missing: bool = False) -> DataFrame:
    """Missing values per sample.

    A matrix that was unpivoted carries its nulls as rows.  For a sparse long
    table pass ``absent_is_missing`` to count absent (sample, probe) rows too;
    a pair counts once, however often it is there, and as present if any of its
    rows has a value.
    """
    if not absent_is_missing:
        return m.groupBy("sample_id").agg(
            F.count_if(F.col("m_value").isNull()).alias("n_missing"))
    n_probes = m.select(F.countDistinct("probe_id").alias("n"))
    return m.groupBy("sample_id").agg(_known("probe_id").alias("n")).select(
        "sample_id", (n_probes.scalar() - F.col("n")).alias("n_missing"))


def _known(column: str) -> Column:
    """How many distinct ids of ``column`` have a value; repeated pairs count once."""
    return F.countDistinct(F.when(F.col("m_value").isNotNull(), F.col(column)))


def drop_sparse_samples(m: DataFrame, max_missing: int = MAX_MISSING,
                        absent_is_missing: bool = False) -> DataFrame:
    """Drop samples with more than ``max_missing`` missing values.

    The anti-join side lists only the rejected samples, so it is normally small
    enough for AQE to broadcast and the measurements stay where they are.
    """
    rejected = missing_per_sample(m, absent_is_missing).filter(
        F.col("n_missing") > max_missing).select("sample_id")
    return m.join(rejected, "sample_id", "left_anti")


def complete_probes(m: DataFrame) -> DataFrame:
    """Probes with a value in every sample; an absent row counts as missing.

    Rows that repeat a (sample, probe) pair do not stand in for missing ones.
    """
    n_samples = m.select(F.countDistinct("sample_id").alias("n"))
    return m.groupBy("probe_id").agg(_known("sample_id").alias("n")).filter(
        F.col("n") == n_samples.scalar()).select("probe_id")


def drop_incomplete_probes(m: DataFrame) -> DataFrame:
    return keep_probes(m, complete_probes(m))


def complete_samples(m: DataFrame) -> DataFrame:
    """Samples with a value for every probe; repeated pairs count once."""
    n_probes = m.select(F.countDistinct("probe_id").alias("n"))
    return m.groupBy("sample_id").agg(_known("probe_id").alias("n")).filter(
        F.col("n") == n_probes.scalar()).select("sample_id")


def filter_long(m: DataFrame, drop: DataFrame, keep: DataFrame) -> DataFrame:
    """Probe in ``keep`` and not in ``drop``, as one semi join.

    Both lists are probe dimensions, so they are combined first and the
    measurements are joined (and, if too big to broadcast, shuffled) once.
    """
    allowed = keep.join(drop, "probe_id", "left_anti").filter(F.col("probe_id").isNotNull())
    return keep_probes(m, allowed)


def write_filtered(m: DataFrame, drop: DataFrame, keep: DataFrame, path: str,
                   file_format: str = "parquet") -> int:
    """Filter, write, and return the number of rows that were written."""
    writer = filter_long(m, drop, keep).write.mode("overwrite")
    written = m.sparkSession.read.schema(m.schema)
    if file_format == "csv":
        writer.option("header", True).csv(path)
        return written.option("header", True).csv(path).count()
    writer.format(file_format).save(path)
    return written.format(file_format).load(path).count()


def filter_cohort(m: DataFrame, probe_meta: DataFrame, blacklist: DataFrame,
                  max_missing: int = MAX_MISSING) -> DataFrame:
    """Gene probes, no sex/mitochondrial probes, no sparse samples, no bad probes."""
    on_genes = filter_long(m, chromosome_probes(probe_meta), gene_probes(probe_meta))
    return (on_genes
            .transform(drop_sparse_samples, max_missing)
            .transform(drop_probes, blacklisted(blacklist, SNP_ADJACENT, CROSS_HYBRIDISING)))


def _probe_stage(probe_meta: DataFrame, blacklist: DataFrame) -> DataFrame:
    """Per probe: how far it gets, ignoring the sample filter.

    1 = has no gene, 2 = on a dropped chromosome, 3 = SNP-adjacent,
    4 = cross-hybridising, 5 = kept.
    """
    listed = blacklist.groupBy("probe_id").agg(
        F.max(F.col("reason") == SNP_ADJACENT).alias("snp"),
        F.max(F.col("reason") == CROSS_HYBRIDISING).alias("cross"))
    meta = probe_meta.groupBy("probe_id").agg(
        F.max(F.col("gencodebasic_name").isNotNull()).alias("gene"),
        F.max(F.coalesce(F.col("chr_hg38").isin(*SEX_AND_MITO), F.lit(False))).alias("xym"))
    stage = (F.when(~F.col("gene"), 1).when(F.col("xym"), 2)
             .when(F.col("snp"), 3).when(F.col("cross"), 4).otherwise(5))
    return meta.join(listed, "probe_id", "left").select("probe_id", stage.alias("stage"))


def qc_report(m: DataFrame, probe_meta: DataFrame, blacklist: DataFrame,
              max_missing: int = MAX_MISSING) -> DataFrame:
    """Samples and probes before and after each step of :func:`filter_cohort`.

    The steps are not run one after the other.  Every probe gets the step that
    removes it and every sample its missing count, both written once; from them
    and one more aggregate per probe all counts follow.  The measurements are
    read twice.
    """
    staged = (m.filter(F.col("probe_id").isNotNull())
              .join(cut(_probe_stage(probe_meta, blacklist)), "probe_id", "left")
              .withColumn("stage", F.coalesce("stage", F.lit(1)))
              .select("sample_id", "probe_id", "stage",
                      F.col("m_value").isNull().alias("gap")))
    per_sample = cut(staged.groupBy("sample_id").agg(
        F.max("stage").alias("top"),
        F.count_if(F.col("gap") & (F.col("stage") >= 3)).alias("n_missing")))
    good = F.col("n_missing") <= max_missing
    samples = per_sample.agg(
        F.count(F.lit(1)).alias("s0"),
        F.count_if(F.col("top") >= 2).alias("s1"),
        F.count_if(F.col("top") >= 3).alias("s2"),
        F.count_if((F.col("top") >= 3) & good).alias("s3"),
        F.count_if((F.col("top") >= 4) & good).alias("s4"),
        F.count_if((F.col("top") >= 5) & good).alias("s5"))

    rejected = per_sample.filter(~good & (F.col("top") >= 3)).select(
        "sample_id", F.lit(True).alias("rejected"))
    per_probe = (staged.join(rejected, "sample_id", "left")
                 .groupBy("probe_id", "stage")
                 .agg(F.max(F.col("rejected").isNull()).alias("seen")))
    alive = F.col("seen")
    probes = per_probe.agg(
        F.count(F.lit(1)).alias("p0"),
        F.count_if(F.col("stage") >= 2).alias("p1"),
        F.count_if(F.col("stage") >= 3).alias("p2"),
        F.count_if((F.col("stage") >= 3) & alive).alias("p3"),
        F.count_if((F.col("stage") >= 4) & alive).alias("p4"),
        F.count_if((F.col("stage") >= 5) & alive).alias("p5"))

    names = ["Gene-Associated Probe Filtering", "XYM Probe Filtering",
             "Problem Sample Filtering", "SNP Adjacent Probe Filtering",
             "Cross-Hybridization Probe Filtering"]

    def steps(prefix: str) -> Column:
        return F.array(*[
            F.struct(F.lit(i + 1).alias("step"), F.lit(name).alias("step_name"),
                     F.col(f"{prefix}{i}").alias("before"),
                     F.col(f"{prefix}{i + 1}").alias("after"))
            for i, name in enumerate(names)])

    s = samples.select(F.inline(steps("s")))
    p = probes.select(F.inline(steps("p")))
    return s.alias("s").join(p.alias("p"), ["step", "step_name"]).select(
        "step", "step_name",
        F.col("s.before").alias("samples_before"), F.col("s.after").alias("samples_after"),
        F.col("p.before").alias("probes_before"), F.col("p.after").alias("probes_after"),
        (F.col("s.before") - F.col("s.after")).alias("samples_removed"),
        (F.col("p.before") - F.col("p.after")).alias("probes_removed"))


def step_shape(step_name: str, before: DataFrame, after: DataFrame) -> DataFrame:
    """One audit row for any single step."""
    b = before.agg(F.countDistinct("sample_id").alias("samples_before"),
                   F.countDistinct("probe_id").alias("probes_before"))
    a = after.agg(F.countDistinct("sample_id").alias("samples_after"),
                  F.countDistinct("probe_id").alias("probes_after"))
    key = F.lit(step_name).alias("step_name")
    return b.select(key, "*").join(a.select(key, "*"), "step_name").select(
        "step_name", "samples_before", "samples_after", "probes_before", "probes_after",
        (F.col("samples_before") - F.col("samples_after")).alias("samples_removed"),
        (F.col("probes_before") - F.col("probes_after")).alias("probes_removed"))
