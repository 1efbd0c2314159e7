"""Explicit schemas of the input tables."""

from __future__ import annotations

from pyspark.sql import types as T


MEASUREMENTS = """sample_id string, meth_sample_id string, probe_id string,
    m_value double, beta_value double"""

# Raw array result files; the newer array carries the locus of the older one.
RAW_V1 = "Name string, MValue double, Beta double"
RAW_V2 = "Name string, EPICv1_Loci string, MValue double, Beta double"

PROBE_META = "probe_id string, gencodebasic_name string, chr_hg38 string"
MANIFEST = """IlmnID string, Name string, EPICv1locmatch string,
    UCSC_RefGene_Name string, GencodeV41_Name string,
    Rep_results_by_NAME string, RMSE_with_WGBS double"""
PROBE_BLACKLIST = "probe_id string, reason string"

TREE_EDGES = "parent string, child string, position int"
TREE_SAMPLES = "disease_name string, sample_id string"

CLINICAL = {
    "analysis_set": "analysis_set_id string, patient_id string, public_subject_id long",
    "purity": "purity_id long, analysis_set_id string, purity double",
    "xref": "biosample_id string, analysis_set_id string",
    "sample": """sample_id string, meth_sample_id string, meth_id string,
        rnaseq_id string, study string, site_sample_id string, patient_id string,
        cancer_category string, cancer_type string, cancer_subtype string,
        diagnosis string, histologic_diagnosis string, final_diagnosis string,
        tree_category string, tree_subcategory1 string,
        tree_subcategory2 string, tree_final_diagnosis string,
        created_at timestamp, updated_at timestamp""",
    "biosample": """biosample_id string, patient_id string,
        public_subject_id long, sample_type string, biosample_status string,
        biosample_type string""",
    "meth_predictions": "sample_id string, meth_group_id string, meth_class_score double",
    "meth_group": """meth_class_id string, meth_class string,
        meth_classifier_id string, meth_group_id string, group_name string""",
    "meth_classifier": """meth_classifier_id string, name string,
        version string, description string""",
    "curated_methylation": """sample_id string, meth_group_id string,
        meth_class_score double, interpretation string, match_site long,
        classification string, reportable long, in_molecular_report long,
        targetable long, created_at timestamp, updated_at timestamp,
        created_by string, updated_by string""",
    "sample_snv": "sample_id string, variant_id string",
    "snv": "variant_id string, gene_id long",
    "gene": """gene_id long, gene string, chromosome string,
        gene_start long, gene_end long""",
    "rnaseq_counts": """rnaseq_id string, gene_id long, fpkm double,
        logFC double, pvalue double, zscore_mean double, fpkm_mean double""",
}

MODEL_PARAMS = """model_module string, model_type string,
    parameters map<string,string>, feature_names array<string>"""

BOOKS = """bookid long, bookTitle string, series string, revision string,
    sections array<struct<chapterTitle: string, chapterLevel: int,
        chapters: array<struct<chapterId: long, chapterTitle: string,
            chapterLevel: int,
            content: array<struct<headingTitle: string,
                contributions: array<struct<headingText: string>>>>,
            attachment: array<struct<type: string, legend: string,
                imageUrl: string, title: string, tablehtml: string>>>>>>"""


def schema(spec: str) -> T.StructType:
    """Parse one of the schema strings of this module."""
    return T.StructType.fromDDL(spec)
