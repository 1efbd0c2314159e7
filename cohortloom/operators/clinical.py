"""Look-ups over the clinical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Fixed values of the clinical tables.
GENOME, METHYLATION = "wgs", "methylation"
TUMOUR, DNA = "tumour", "dna"
MIN_PURITY = 0.30


def project(table: DataFrame, columns=None, ids: DataFrame | None = None,
            key: str = "sample_id") -> DataFrame:
    """Chosen columns, optionally only rows whose ``key`` is in ``ids``.

    The id frame has one column; its name does not matter.
    """
    out = table
    if ids is not None:
        wanted = ids.select(F.col(ids.columns[0]).alias(key))
        out = out.join(wanted, key, "left_semi")
    return out.select(*columns) if columns else out


def diagnoses(sample: DataFrame, column: str = "tree_final_diagnosis") -> DataFrame:
    return sample.select(column)


def patient_samples(sample: DataFrame, patients: DataFrame) -> DataFrame:
    return project(sample, ["sample_id"], patients, key="patient_id")


def purity_of(xref: DataFrame, biosample: DataFrame, purity: DataFrame,
              ids: DataFrame | None = None) -> DataFrame:
    """Purity of the tumour DNA genomes, one row per purity record."""
    tumour = biosample.filter(
        (F.col("sample_type") == GENOME) & (F.col("biosample_status") == TUMOUR)
        & (F.col("biosample_type") == DNA))
    if ids is not None:
        tumour = project(tumour, ids=ids, key="biosample_id")
    return xref.join(tumour, "biosample_id").join(purity, "analysis_set_id").select(
        "biosample_id", "analysis_set_id", "patient_id", "public_subject_id", "sample_type",
        "biosample_status", "biosample_type", "purity_id", "purity")


def pure_samples(tree_samples: DataFrame, purities: DataFrame,
                 floor: float = MIN_PURITY) -> DataFrame:
    """Tree samples with some purity strictly above ``floor``."""
    pure = purities.filter(F.col("purity") > floor).select(
        F.col("biosample_id").alias("sample_id"))
    return tree_samples.join(pure, "sample_id", "left_semi")


def pure_patients_samples(sample: DataFrame, analysis_set: DataFrame, purity: DataFrame,
                          floor: float = MIN_PURITY) -> DataFrame:
    """Samples whose patient has any purity strictly above ``floor``.

    Semi-joins: a patient with many analysis sets multiplies nothing.
    """
    sets = analysis_set.join(purity.filter(F.col("purity") > floor),
                             "analysis_set_id", "left_semi")
    return sample.join(sets, "patient_id", "left_semi")


def _typed(xref: DataFrame, biosample: DataFrame, sample_type: str) -> DataFrame:
    wanted = biosample.filter(F.col("sample_type") == sample_type).select("biosample_id")
    return xref.join(wanted, "biosample_id", "left_semi").select(
        "analysis_set_id", "biosample_id")


def convert_ids(xref: DataFrame, biosample: DataFrame, input_type: str, output_type: str,
                ids: DataFrame | None = None) -> DataFrame:
    """Ids of one sample type with the ids of another from the same analysis set.

    Each side is cut to its type (and the input to the asked ids) before the two
    meet, so nothing but the answer's own rows comes out of the join.
    """
    source = _typed(xref, biosample, input_type)
    if ids is not None:
        source = project(source, ids=ids, key="biosample_id")
    target = _typed(xref, biosample, output_type)
    return source.withColumnRenamed("biosample_id", f"{input_type}_id").join(
        target.withColumnRenamed("biosample_id", f"{output_type}_id"),
        "analysis_set_id").select(f"{input_type}_id", f"{output_type}_id")


def methylation_siblings(xref: DataFrame, biosample: DataFrame, ids: DataFrame) -> DataFrame:
    """Methylation ids in the analysis sets of ``ids``.

    ``n_requested`` is how many asked ids led to the sibling, so repeats are
    counted per analysis set rather than multiplied out.
    """
    asked = project(xref, ids=ids, key="biosample_id").groupBy("analysis_set_id").agg(
        F.count(F.lit(1)).alias("n_requested"))
    return _typed(xref, biosample, METHYLATION).join(asked, "analysis_set_id").select(
        "biosample_id", "analysis_set_id", "n_requested")


def sample_ids(sample: DataFrame, xref: DataFrame, biosample: DataFrame,
               patients: DataFrame | None = None) -> DataFrame:
    """Ids of some patients' samples, or all methylation ids of all genome samples.

    The second form adds ``n_requested``, how many genomes led to the id.
    """
    if patients is not None:
        return patient_samples(sample, patients)
    genomes = project(biosample.filter(F.col("sample_type") == GENOME), ["biosample_id"],
                      sample.select("sample_id"), key="biosample_id")
    return methylation_siblings(xref, biosample, genomes).select(
        F.col("biosample_id").alias("sample_id"), "n_requested")


def prefixed(table: DataFrame, name: str) -> DataFrame:
    return table.select(*[F.col(c).alias(f"{name}_{c}") for c in table.columns])


def classifier_results(sample: DataFrame, curated: DataFrame, group: DataFrame,
                       classifier: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Curated classifier calls with their group and classifier, prefixed by table."""
    asked = project(sample, ids=ids) if ids is not None else sample
    s, c = prefixed(asked, "Sample"), prefixed(curated, "CuratedMethylation")
    g, k = prefixed(group, "MethylationGroup"), prefixed(classifier, "MethylationClassifier")
    return (s.join(c, F.col("Sample_meth_sample_id") == F.col("CuratedMethylation_sample_id"))
            .join(g, F.col("CuratedMethylation_meth_group_id")
                  == F.col("MethylationGroup_meth_group_id"))
            .join(k, F.col("MethylationGroup_meth_classifier_id")
                  == F.col("MethylationClassifier_meth_classifier_id")))


def flatten(*joined: DataFrame, on) -> DataFrame:
    """Join tables left to right; where names repeat, the later table's column stays."""
    out = joined[0]
    keys = [on] if isinstance(on, str) else list(on)
    for table in joined[1:]:
        repeated = [c for c in out.columns if c in table.columns and c not in keys]
        out = out.drop(*repeated).join(table, keys)
    return out


def classifier_pivot(calls: DataFrame, values, order_by: str, classifiers=None,
                     index: str = "sample_id") -> DataFrame:
    """One row per sample, ``<value>_<name>_<version>`` columns, first call, "-" if none.

    "First" follows ``order_by`` and skips nulls.  Naming the classifiers saves
    the pass that would look them up.
    """
    named = calls.withColumn("classifier", F.concat_ws("_", "name", "version"))
    firsts = [
        F.min_by(F.col(v).cast("string"), F.when(F.col(v).isNotNull(), F.col(order_by))).alias(v)
        for v in values]
    if classifiers is None:
        classifiers = sorted(r[0] for r in named.select("classifier").distinct().collect())
    wide = named.groupBy(index).pivot("classifier", classifiers).agg(*firsts)
    many = len(firsts) > 1
    columns = [F.coalesce(F.col(f"`{k}_{v}`" if many else f"`{k}`"), F.lit("-")).alias(f"{v}_{k}")
               for v in values for k in classifiers]
    return wide.select(index, *columns)
