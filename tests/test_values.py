from pyspark.sql import functions as F

from cohortloom.functions import values as vf


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("r")).first().r


def test_patient_ids(spark):
    assert one(spark, vf.patient_id, "P000101_244263_T_W") == "P000101"
    assert one(spark, vf.patient_id, "06-0086_410877_T_W") == "06-0086"
    assert one(spark, vf.patient_id, "xyz") is None
    assert one(spark, vf.patient_id, "Px") == "P"


def test_file_names(spark):
    path = "/path/to/P000101_244263_T_M.csv"
    assert tuple(one(spark, vf.sibling_names, path)) == (
        "P000101_244263_T_M.csv", "P000101_244263_T_W", "P000101_244263_T_M")
    assert tuple(one(spark, vf.sibling_names, "/a/other.csv")) == ("other.csv",) * 3
    assert one(spark, vf.methylation_name, path) == "P000101_244263_T_M"
    assert one(spark, vf.methylation_name, "other.csv") == "other.csv"


def test_suffix_is_removed_whole(spark):
    ids = lambda c: vf.id_from_file_name(c, ["_anno_hg38.txt", "_anno.txt"])
    # Letters of the suffix at the end of the id stay.
    assert one(spark, ids, "sample_xtan_anno_hg38.txt") == "sample_xtan"
    assert one(spark, ids, "s_anno.txt") == "s"
    assert one(spark, ids, "s.csv") == "MysterySample"


def test_numbers(spark):
    for text in ("abc", "NaN", "Infinity", "-Infinity", None):
        assert one(spark, vf.clean_number, text) is None
    assert one(spark, vf.clean_number, "-1.5e2") == -150.0
