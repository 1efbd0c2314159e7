"""Column expressions for values, ids and file names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Id and file-name patterns of the cohort.
PATIENT_ID_PATTERN = r"P\d*|\d{2}-\d{4}"
METHYLATION_MARK = "_T_M"
GENOME_MARK = "_T_W"
UNKNOWN_SAMPLE = "MysterySample"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_number(c) -> Column:
    """Value as a double; text that is no number, NaN and infinities are null."""
    value = _col(c).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def base_name(c) -> Column:
    return F.regexp_extract(_col(c), r"([^/]*)$", 1)


def id_from_file_name(c, suffixes, default: str = UNKNOWN_SAMPLE) -> Column:
    """File name without the first suffix it ends with, else ``default``."""
    name = _col(c)
    out = F.lit(default)
    for suffix in reversed(list(suffixes)):
        stem = F.left(name, F.length(name) - F.lit(len(suffix)))
        out = F.when(F.endswith(name, F.lit(suffix)), stem).otherwise(out)
    return out


def patient_id(c) -> Column:
    """First patient id inside a sample id, null if there is none."""
    return F.nullif(F.regexp_extract(_col(c), PATIENT_ID_PATTERN, 0), F.lit(""))


def methylation_name(path) -> Column:
    """Base name up to the methylation mark, or the whole base name."""
    name = base_name(path)
    hit = F.regexp_extract(name, f"^.*?{METHYLATION_MARK}", 0)
    return F.when(hit != "", hit).otherwise(name)


def sibling_names(path) -> Column:
    """Struct (file_name, sample_name, meth_name); the base name thrice if unmarked."""
    name = base_name(path)
    stem = F.regexp_extract(name, f"^(.*?){METHYLATION_MARK}", 1)
    marked = F.contains(name, F.lit(METHYLATION_MARK))
    return F.struct(
        name.alias("file_name"),
        F.when(marked, F.concat(stem, F.lit(GENOME_MARK))).otherwise(name).alias("sample_name"),
        F.when(marked, F.concat(stem, F.lit(METHYLATION_MARK))).otherwise(name).alias("meth_name"),
    )
