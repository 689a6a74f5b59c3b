"""A name of an institution is cut out of its text once a row."""

from pyspark.sql import functions as F

from normgraph.functions import ident


def test_institution_is_cut_out_once(spark):
    texts = ["x milik instansi RSUD Kediri.", "milik instansi Pemkot .", "milik instansi PT Maju Jaya Abadi.", "nothing", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(ident.institution_code(ident.institution(F.col("text"))).alias("code"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") <= 2
    assert [r.code for r in df.collect()] == ["RSUD-KEDIRI", "PEMKOT-UNK", "PT-MAJU", None, None]
